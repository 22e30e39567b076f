"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are dealt into classes by their number of shingles. For a class of items of up to h
shingles, a document is read in windows of 2h shingles, h apart, so that any passage of h shingles
lies whole in one window and item and window are of like size, however long the document is. An item
and a window are candidates where any of ``HASHES`` minima agree; exact shingle containment in the whole document then decides.
Items of up to ``STEP`` shingles would be too small beside the windows: of n shingles, a document that holds 0.8
has one of any n - ceil(0.8 n) + 1, and those are looked up in a table, which misses none.

A larger item contained to 0.8 in a window has a Jaccard similarity of 0.19 or more with it, so a
candidate is missed with a chance under 0.81 ** 64, about one in a million. Items go to the tasks in blocks
of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, id_text, keep_rows, slices, text_bytes, words

SHINGLE = 5
CONTAINMENT = 0.8
HASHES = 64
#: Items, and bytes of item text, that one pass over the documents carries to the tasks.
ITEMS, ITEM_BYTES = 10_000, 32 << 20
#: Shingles of a block; windows are runs of blocks.
STEP = 8
_U = np.uint64
_RANDOM = np.random.default_rng(20_240_601)
_FACTORS = _RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)


@dataclass
class SizeClass:
    """Items of up to ``high`` shingles: their minima, and for each hash the sorted minima with a filter of their low bits."""

    high: int
    items: np.ndarray
    order: np.ndarray
    minima: np.ndarray
    filters: np.ndarray


@dataclass
class Benchmark:
    """The items of one block. ``few``: shingles of the items of up to ``STEP``, rising, their items, and a filter of their low bits. ``short``: items of fewer words than a shingle, by word count, matched by their whole word sequence."""

    item_ids: list[int | None]
    shingles: list[np.ndarray]
    classes: list[SizeClass]
    few: tuple[np.ndarray, np.ndarray, np.ndarray]
    short: dict[int, dict[int, list[int]]]


def _minhash(shingles: np.ndarray, k: int) -> np.ndarray:
    return (shingles >> _U(32)).astype(np.uint32) * _FACTORS[k] + _OFFSETS[k]


def benchmark_of(rows: list[tuple[int | None, str | None]]) -> Benchmark:
    item_ids = [r[0] for r in rows]
    w = words([(r[1] or "").encode() for r in rows], lower=True, between=NOT_WORD)
    hashes, owner = w.shingles(SHINGLE)
    count = np.diff(w.first)
    bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
    shingles = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(len(rows))]
    short: dict[int, dict[int, list[int]]] = {}
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        short.setdefault(int(count[i]), {}).setdefault(int(shingles[i][0]), []).append(int(i))
    size = np.array([len(s) if n >= SHINGLE else 0 for s, n in zip(shingles, count)])
    classes, high = [], 2 * STEP
    while size.max(initial=0) > high // 2:
        items = np.flatnonzero((size > high // 2) & (size <= high))
        if len(items):
            minima = np.array([[_minhash(shingles[i], k).min() for i in items] for k in range(HASHES)], np.uint32)
            order = np.argsort(minima, axis=1, kind="stable")
            filters = np.zeros((HASHES, 1 << 16), bool)
            for k in range(HASHES):
                filters[k, minima[k] & np.uint32(0xFFFF)] = True
            classes.append(SizeClass(high, items, order, np.take_along_axis(minima, order, axis=1), filters))
        high *= 2
    few = sorted((int(h), int(i)) for i in np.flatnonzero((size > 0) & (size <= STEP)) for h in shingles[i][: size[i] - int(np.ceil(CONTAINMENT * size[i] - 1e-9)) + 1])
    keys = np.array([h for h, _ in few], _U)
    seen = np.zeros(1 << 16, bool)
    seen[keys & _U(0xFFFF)] = True
    return Benchmark(item_ids, shingles, classes, (keys, np.array([i for _, i in few], np.int64), seen), short)


def candidates(known: Benchmark, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(document, item) pairs with an agreeing minimum in some window, or with a shingle of the table of small items. ``doc``: the document of each shingle, rising."""
    if not len(hashes):
        return np.zeros((0, 2), np.int64)
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    size = np.diff(np.append(first, len(doc)))
    blocks = -(-size // STEP)
    block_of_doc = np.concatenate(([0], np.cumsum(blocks)))
    begin = np.repeat(first - block_of_doc[:-1] * STEP, blocks) + np.arange(block_of_doc[-1]) * STEP
    spans = []
    for c in known.classes:
        stride = c.high // STEP
        n = np.maximum(1, -(-blocks // stride) - (blocks > stride))
        start = np.repeat(block_of_doc[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride
        stop = np.minimum(start + 2 * stride, np.repeat(block_of_doc[1:], n))
        spans.append((np.stack([start, stop], axis=1).ravel(), np.repeat(np.arange(len(first)), n)))
    found = []
    keys, items, seen = known.few
    at = np.flatnonzero(seen[hashes & _U(0xFFFF)])
    low, high = (np.searchsorted(keys, hashes[at], side=side) for side in ("left", "right"))
    for d, a, b in zip(doc[at[low < high]], low[low < high], high[low < high]):
        found += [(d, i) for i in items[a:b]]
    folded = (hashes >> _U(32)).astype(np.uint32)
    for k in range(HASHES):
        least = np.append(np.minimum.reduceat(folded * _FACTORS[k] + _OFFSETS[k], begin), np.uint32(0xFFFFFFFF))
        for c, (span, owner) in zip(known.classes, spans):
            window = np.minimum.reduceat(least, span)[::2]
            hit = np.flatnonzero(c.filters[k, window & np.uint32(0xFFFF)])
            if not len(hit):
                continue
            low, high = (np.searchsorted(c.minima[k], window[hit], side=side) for side in ("left", "right"))
            for h, a, b in zip(hit[low < high], low[low < high], high[low < high]):
                for i in c.items[c.order[k, a:b]]:
                    found.append((doc[first[owner[h]]], i))
    return np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)


def leaks_in(known: Benchmark, texts: list[bytes], short: bool = True) -> list[tuple[int, int, int, int]]:
    """(text, item, shared shingles, the item's shingles) of all items found in the texts; without ``short``, of those of a shingle or more."""
    w = words(texts, lower=True, between=NOT_WORD)
    hashes, doc = w.shingles(SHINGLE)
    out, last, own = [], -1, np.zeros(0, _U)
    for d, i in candidates(known, hashes, doc).tolist():
        if d != last:
            own, last = hashes[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")], d
        item = known.shingles[i]
        shared = int(np.isin(item, own).sum())
        if shared >= CONTAINMENT * len(item):
            out.append((d, i, shared, len(item)))
    for n, table in known.short.items() if short else ():
        at = np.flatnonzero(w.doc[: len(w.doc) - n + 1] == w.doc[n - 1 :]) if len(w.doc) >= n else np.zeros(0, np.int64)
        if not len(at):
            continue
        keys, owner = w.shingles(n)
        for j in np.flatnonzero(np.isin(keys, np.array(list(table), _U))):
            if w.first[owner[j] + 1] - w.first[owner[j]] >= n:
                out += [(int(owner[j]), i, 1, 1) for i in table[int(keys[j])]]
    return sorted(set(out))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of at most ``ITEMS`` rows and about ``ITEM_BYTES`` of text, read block by block."""
    own = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    rows, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-rows // (ITEMS // 2)), -(-size // (ITEM_BYTES // 2)))
    for k in range(n):
        block = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else own
        yield [(r.item_id, r.text) for r in block.distinct().orderBy("item_id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): every item with 0.8 or more of its five-word shingles in a document.

    Words are runs of letters and digits of any script, A-Z lower-cased. Items of one to four words are
    found where those words stand in a row; empty and null items and documents match nothing. Repeated items count once, repeated
    documents each. Null ids stay null. An empty table on either side gives an empty result; other columns are ignored.
    """
    own, schema = id_text(docs, id_col, text_col), "doc_id long, item_id long, n_shared long, n_item long, containment double"
    out: DataFrame | None = None
    for rows in item_blocks(benchmark, item_col, item_text_col):
        known = docs.sparkSession.sparkContext.broadcast(benchmark_of(rows))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            items = known.value
            for batch in batches:
                ids, texts, got = batch["doc_id"].to_pylist(), text_bytes(batch["text"]), []
                for i, j in slices(texts):
                    got += [(ids[i + d], items.item_ids[k], shared, size, shared / size) for d, k, shared, size in leaks_in(items, texts[i:j])]
                types = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [[]] * 5, types)], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        part = own.mapInArrow(lambda batches, f=run: f(batches), schema)
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", short: bool = False) -> DataFrame:
    """The documents in which no item is found, with all their columns.

    Items of fewer words than a shingle ("yes", "in Paris") stand in clean documents too, so they remove none unless ``short`` is set; ``find_leaks`` reports them.
    """
    for rows in item_blocks(benchmark, item_col, item_text_col):
        docs = keep_rows(docs, text_col, _clean(docs.sparkSession.sparkContext.broadcast(benchmark_of(rows)), short))
    return docs


def _clean(known, short: bool):
    def verdict(texts: list[bytes]) -> np.ndarray:
        flags = np.ones(len(texts), bool)
        flags[[d for d, *_ in leaks_in(known.value, texts, short)]] = False
        return flags

    return verdict
