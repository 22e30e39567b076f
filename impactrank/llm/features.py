"""Hashed n-gram features of whole texts, for the two quality models."""

from __future__ import annotations

import numpy as np

from .common import Words, mix

#: Slots of hashed character trigrams, words and word pairs, then the repetition slots.
CHARS, SINGLE, PAIRS = 2048, 1024, 512
SHAPES = 12
WIDTH = CHARS + SINGLE + PAIRS + SHAPES
_U = np.uint64


def _slot(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes >> _U(40)).astype(np.int64) % size


def _unit(block: np.ndarray) -> np.ndarray:
    """Damped counts scaled to length one."""
    block = np.sqrt(block)
    return block / np.maximum(np.sqrt((block**2).sum(axis=1, keepdims=True)), 1e-9)


def repeated(w: Words, n: int) -> np.ndarray:
    """Flags of the words that stand in an n-word window found twice or more in their document, the first included."""
    out = np.zeros(len(w.hash), bool)
    if len(w.hash) < n:
        return out
    key = np.zeros(len(w.hash) - n + 1, _U)
    for j in range(n):
        key = key * _U(0x9FB21C651E98DF25) + w.hash[j : len(w.hash) - n + 1 + j]
    at = np.flatnonzero(w.doc[: len(key)] == w.doc[n - 1 :])
    key = mix(key[at] + w.doc[at].astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for j in range(n):
        out[at[twice] + j] = True
    return out


def matrix(w: Words) -> np.ndarray:
    """(documents, WIDTH) float32. A text without words has zeros but for the constant slot."""
    n = len(w.bounds) - 1
    data = w.data.astype(np.uint32)
    codes = data[:-2] * np.uint32(0x01000193) ^ data[1:-1] * np.uint32(0x9E3779B1) ^ data[2:] * np.uint32(0x85EBCA77)
    codes = (codes * np.uint32(0x27D4EB2F)) >> np.uint32(21)
    owner = np.repeat(np.arange(n), np.diff(w.bounds))
    inside = owner[2:] == owner[: len(codes)]
    chars = np.bincount(owner[: len(codes)][inside] * CHARS + codes[inside], minlength=n * CHARS).reshape(n, CHARS)
    single = np.bincount(w.doc * SINGLE + _slot(mix(w.hash), SINGLE), minlength=n * SINGLE).reshape(n, SINGLE)
    both = w.doc[1:] == w.doc[:-1]
    pair = mix(w.hash[:-1] * _U(0x9FB21C651E98DF25) + w.hash[1:])[both]
    pairs = np.bincount(w.doc[1:][both] * PAIRS + _slot(pair, PAIRS), minlength=n * PAIRS).reshape(n, PAIRS)

    count = np.diff(w.first)
    per = np.maximum(count, 1)
    again = np.zeros(len(w.hash), bool)
    again[1:] = both & (w.hash[1:] == w.hash[:-1])
    key = mix(w.hash + w.doc.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    _, at = np.unique(key, return_index=True)
    fresh = np.zeros(len(w.hash), bool)
    fresh[at] = True
    is_upper = (w.data >= 65) & (w.data <= 90)
    is_lower = ((w.data >= 97) & (w.data <= 122)) | (w.data >= 128)
    is_digit = (w.data >= 48) & (w.data <= 57)
    is_line = w.data == 10
    letters = w.per_doc(is_upper | is_lower)
    size = np.maximum(np.diff(w.bounds) - 1, 1)
    mark = size - letters - w.per_doc(is_digit) - w.per_doc((w.data == 32) | is_line)
    length = w.end - w.start
    shapes = [
        w.per_doc_words(again) / per,
        w.per_doc_words(repeated(w, 2)) / per,
        w.per_doc_words(repeated(w, 3)) / per,
        w.per_doc_words(fresh) / np.sqrt(per) / 10,
        w.per_doc(is_upper) / np.maximum(letters, 1),
        mark / size,
        w.per_doc(is_digit) / size,
        np.log1p(count) / 10,
        w.per_doc_words(length) / per / 20,
        w.per_doc_words(length > 30) / per,
        w.per_doc(is_line) / per,
        np.ones(n),
    ]
    return np.hstack([_unit(chars), _unit(single), _unit(pairs), 2 * np.stack(shapes, axis=1)]).astype(np.float32)
