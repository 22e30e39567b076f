"""Shared helpers, and a NumPy text kernel for Arrow batches.

The kernel finds words and hashes them for many documents at once, so that operators pay a few
vector operations a byte instead of a Python step a word.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactrank.shared import checkpointed  # noqa: F401

#: Bytes of text that the kernel handles at once; one longer document is handled whole.
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_WORD = np.uint64
_ROOM: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the text operators need, whatever else the table holds."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def fold(id_column: Column, n: int) -> Column:
    """crc32 of the decimal id, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc_fold(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes together."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text) > most:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _WORD(32))
    x = x * _WORD(0xD6E8FEB86659FD93)
    x = x ^ (x >> _WORD(32))
    x = x * _WORD(0xD6E8FEB86659FD93)
    return x ^ (x >> _WORD(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept, and grown when a longer text comes."""
    if len(_ROOM.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, _WORD(base))
            steps[0] = 1
            _ROOM[name] = np.multiply.accumulate(steps)
        if size > SLICE_BYTES * 2:
            return _ROOM.pop("up"), _ROOM.pop("down")
    return _ROOM["up"], _ROOM["down"]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII but for digits and lower-case letters: what stands between the words of lower-cased text.
NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False


@dataclass
class Words:
    """Words of some documents: byte ranges in ``data``, their document and 64-bit hashes.

    ``bounds[i]`` is where document i begins in ``data``; documents stand between newlines.
    ``first[i]`` is the index of its first word.
    """

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    prefix: np.ndarray

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of any byte ranges; equal bytes give equal hashes."""
        _, down = _powers(len(self.data) + 1)
        return mix((self.prefix[end] - self.prefix[start]) * down[start] + (end - start).astype(_WORD))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of per-byte values by document."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.bounds[1:] - 1] - total[self.bounds[:-1]]

    def per_doc_words(self, flags: np.ndarray) -> np.ndarray:
        """Sums of per-word values by document."""
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows and the document of each; shorter documents give one window of all their words."""
        lens = np.diff(self.first)
        if len(self.hash) >= n:
            out = np.zeros(len(self.hash) - n + 1, _WORD)
            for j in range(n):
                out = out * _WORD(0x9FB21C651E98DF25) + self.hash[j : len(self.hash) - n + 1 + j]
            whole = self.doc[: len(out)] == self.doc[n - 1 :]
            hashes, docs = mix(out[whole]), self.doc[: len(out)][whole]
        else:
            hashes, docs = np.zeros(0, _WORD), np.zeros(0, np.int64)
        short = np.flatnonzero((lens > 0) & (lens < n))
        if len(short):
            extra = []
            for i in short:
                h = 0
                for w in self.hash[self.first[i] : self.first[i + 1]].tolist():
                    h = (h * 0x9FB21C651E98DF25 + w) & (2**64 - 1)
                extra.append(h)
            hashes = np.concatenate((hashes, mix(np.array(extra, _WORD))))
            docs = np.concatenate((docs, short))
            order = np.argsort(docs, kind="stable")
            hashes, docs = hashes[order], docs[order]
        return hashes, docs


def words(texts: list[bytes], lower: bool = False, between: np.ndarray = _SPACE) -> Words:
    """Words separated by the bytes flagged in ``between``; ``lower`` lower-cases A-Z first."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    space = between[data]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, _ = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, _WORD)
    np.cumsum((data.astype(_WORD) + _WORD(1)) * up[: len(data)], out=prefix[1:])
    doc = np.searchsorted(bounds, start, side="right") - 1
    first = np.searchsorted(start, bounds)
    out = Words(data, bounds, start, end, doc, first, np.zeros(0, _WORD), prefix)
    out.hash = out.span_hash(start, end)
    return out


def give_back() -> None:
    """Let the system have what this worker no longer uses. Spark keeps workers for later tasks, and beside them its own heap needs the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # of the GNU library alone
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and what it leaves unused given back at the end of the task."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return own


def keep_rows(docs: DataFrame, text_col: str, verdict: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows whose text passes ``verdict``, with all their columns, in one pass over Arrow batches.

    ``verdict`` gets half a megabyte of texts at a time (null as empty) and gives a flag for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch[text_col])
            flags = [verdict(texts[i:j]) for i, j in slices(texts)]
            if flags:
                yield batch.filter(pa.array(np.concatenate(flags)))

    return docs.mapInArrow(lean(run), docs.schema)
