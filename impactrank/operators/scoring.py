"""Sums of impacts for many queries at once.

Stored bodies are dealt by block of documents and, within a block, by the remainder of the docid, so that a part holds some ten thousand documents. What a
part needs of a body comes once for up to ``TOGETHER`` queries, with what each of them gains by it; no row of a (query, posting) is made or shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactrank.shared import written

from .index import BODY_BITS, Index

#: Documents of a part, as a power of two, about; queries that are scored together, about.
PART_BITS, TOGETHER = 15, 128
#: Segments of a batch up to which they are sent to every task, so that bodies are read and not shuffled to meet them.
SENT_SEGMENTS = 1 << 18
#: Pairs of a query and a posting that are made at once, postings that wait to be added, and the postings of a row from which it is added alone.
PAIRS, WAITING, ALONE = 1 << 21, 1 << 18, 256
#: Hits that one task ranks, about, where all hits of a query are ranked.
HITS = 1 << 20
DEALT = "many int, block long, part int, queries array<long>, gains array<long>, docids array<long>"
_NAMES = ["many", "block", "part", "queries", "gains", "docids"]
CELLS = "query_id long, rsv long, block long, docids array<long>"


def scores(chosen: DataFrame, index: Index, k: int | None = None) -> DataFrame:
    """(query_id, docid, rsv) of chosen (query_id, term, impact, times) segments; with ``k`` at least the k best of each query, those of each part."""
    return _scored(written(chosen), index, k)


def cells(chosen: DataFrame, index: Index, k: int | None = None) -> tuple[DataFrame, int]:
    """(query_id, rsv, block, docids), the same hits as arrays, a row for each score of a query in a part of a block; and a number of tasks in proportion to the hits. ``chosen`` has freq too."""
    chosen = written(chosen)
    read, queries = chosen.agg(F.sum("freq"), F.count_distinct("query_id")).first()
    most = min(read or 0, (queries + 1) * index.docs.count())  # a null query is not counted
    return _scored(chosen, index, k, True), max(1, math.ceil(most / HITS))


def _scored(chosen: DataFrame, index: Index, k: int | None, as_cells: bool = False) -> DataFrame:
    segments, queries = chosen.agg(F.count("*"), F.count_distinct("query_id")).first()
    groups = max(1, math.ceil(queries / TOGETHER))
    parts = parts_of(index)
    gain = F.struct("query_id", (F.col("impact").cast("long") * F.col("times")).alias("gain"))
    wanted = chosen.withColumn("many", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).groupBy("term", "impact", "many").agg(F.collect_list(gain).alias("q"))
    wanted = F.broadcast(wanted) if segments <= SENT_SEGMENTS else wanted
    met = index.arrays().join(wanted, ["term", "impact"]).select("many", "block", F.lit(0).alias("part"), F.col("q.query_id").alias("queries"), F.col("q.gain").alias("gains"), "docids")
    rows = met.mapInArrow(dealt(parts), DEALT) if parts > 1 else met
    tasks = min(1 << 11, 2 * groups * parts * (1 + len(index.cuts or [])))
    return rows.repartition(tasks, "many", "block", "part").sortWithinPartitions("many", "block", "part").mapInArrow(_summed(k, as_cells), CELLS if as_cells else "query_id long, docid long, rsv long")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The number of values of each row, and all values."""
    return np.asarray(column.value_lengths(), np.int64), column.flatten()


def parts_of(index: Index) -> int:
    """The parts of a block of documents."""
    return min(1 << max(0, BODY_BITS - PART_BITS), max(1, math.ceil(index.docs.count() / (1 << PART_BITS))))


def dealt(parts: int, more: tuple[str, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row as one for each part that has some of its docids; ``more`` columns go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, flat = _flat(batch["docids"])
            ids = np.asarray(flat, np.int64)
            row = np.repeat(np.arange(len(size)), size)
            part = (ids % parts).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            ids, row, part = ids[order], row[order], part[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(ids)), bool), (row[1:] != row[:-1]) | (part[1:] != part[:-1]))))
            ends = pa.array(np.append(first, len(ids)), pa.int32())
            for i in range(0, len(first), 1 << 13):  # a row's queries are repeated for each of its parts, so some thousand at a time
                own = first[i : i + (1 << 13)]
                same = pa.array(row[own])
                yield pa.RecordBatch.from_arrays([batch["many"].take(same), batch["block"].take(same), pa.array(part[own].astype(np.int32)), batch["queries"].take(same), batch["gains"].take(same), pa.ListArray.from_arrays(ends.slice(i, len(own) + 1), pa.array(ids)), *(batch[c].take(same) for c in more)], names=[*_NAMES, *more])

    return run


class _Part:
    """Scores of the documents of a part, a row for each query that has met one."""

    def __init__(self) -> None:
        self.ids = np.zeros(0, np.int64)
        self.rows: dict[int | None, int] = {}
        self.held = np.zeros((0, 0), np.int64)

    def numbers(self, queries: list[int | None]) -> np.ndarray:
        """The rows of queries; unseen ones get one."""
        out = np.array([self.rows.setdefault(q, len(self.rows)) for q in queries], np.int64)
        if len(self.rows) > len(self.held):
            self.held = np.concatenate((self.held, np.zeros((max(16, 2 * len(self.rows)) - len(self.held), len(self.ids)), np.int64)))
        return out

    def places(self, docids: np.ndarray) -> np.ndarray:
        """The places of documents; unseen ones get one."""
        at = np.searchsorted(self.ids, docids)
        new = self.ids[np.minimum(at, len(self.ids) - 1)] != docids if len(self.ids) else np.ones(len(docids), bool)
        if not new.any():
            return at
        ids = np.union1d(self.ids, docids[new])
        held = np.zeros((len(self.held), len(ids)), np.int64)
        held[:, np.searchsorted(ids, self.ids)] = self.held
        self.ids, self.held = ids, held
        return np.searchsorted(ids, docids)

    def add(self, row: np.ndarray, gain: np.ndarray, n_queries: np.ndarray, docids: np.ndarray, n_docids: np.ndarray) -> None:
        """Add bodies: each has a number of queries, with what they gain by each of its documents, and a number of documents."""
        at = self.places(docids)
        q_first, d_first = np.cumsum(n_queries) - n_queries, np.cumsum(n_docids) - n_docids
        for i in np.flatnonzero(n_docids >= ALONE).tolist():
            own = at[d_first[i] : d_first[i] + n_docids[i]]
            for q, g in zip(row[q_first[i] : q_first[i] + n_queries[i]].tolist(), gain[q_first[i] : q_first[i] + n_queries[i]].tolist()):
                self.held[q, own] += g
        short = np.flatnonzero(n_docids < ALONE)
        total = np.cumsum(n_docids[short] * n_queries[short])
        begin = 0
        while begin < len(short):  # a body of many queries may exceed PAIRS alone
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, side="right")))
            self._pairs(short[begin:end], row, gain, n_queries, q_first, at, n_docids, d_first)
            begin = end

    def _pairs(self, bodies: np.ndarray, row: np.ndarray, gain: np.ndarray, n_queries: np.ndarray, q_first: np.ndarray, at: np.ndarray, n_docids: np.ndarray, d_first: np.ndarray) -> None:
        many = n_docids[bodies] * n_queries[bodies]
        body = np.repeat(bodies, many)
        place = np.arange(len(body)) - np.repeat(np.cumsum(many) - many, many)
        q, d = np.divmod(place, n_docids[body])
        q += q_first[body]
        np.add.at(self.held.reshape(-1), row[q] * len(self.ids) + at[d_first[body] + d], gain[q])

    def hits(self, k: int | None) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
        """(query, docids, scores), cut to the k best."""
        for query, i in self.rows.items():
            own = self.held[i]
            hit = np.flatnonzero(own)
            if k is not None and len(hit) > k:
                hit = hit[own[hit] >= np.partition(own[hit], len(hit) - k)[len(hit) - k]]
                hit = hit[np.lexsort((-self.ids[hit], -own[hit]))[:k]]
            yield query, self.ids[hit], own[hit]

    def best(self, k: int | None) -> Iterator[pa.RecordBatch]:
        for query, ids, own in self.hits(k):
            yield pa.RecordBatch.from_arrays([_same(query, len(ids)), pa.array(ids), pa.array(own)], names=["query_id", "docid", "rsv"])

    def cells(self, k: int | None, block: int) -> Iterator[pa.RecordBatch]:
        for query, ids, own in self.hits(k):
            order = np.argsort(own, kind="stable")
            own = own[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))
            docids = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)), pa.int32()), pa.array(ids[order]))
            yield pa.RecordBatch.from_arrays([_same(query, len(first)), pa.array(own[first]), _same(block, len(first)), docids], names=["query_id", "rsv", "block", "docids"])


def _same(value: int | None, n: int) -> pa.Array:
    return pa.array([value], pa.int64()).take(pa.array(np.zeros(n, np.int64)))


def _summed(k: int | None, as_cells: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        part, waiting, held = _Part(), [], 0
        best = lambda: part.cells(k, key[1]) if as_cells else part.best(k)

        def added() -> None:
            nonlocal held
            if waiting:
                part.add(*(np.concatenate(x) for x in zip(*waiting)))
            waiting.clear()
            held = 0

        for batch in batches:
            keys = [np.asarray(batch[c]) for c in ("many", "block", "part")]
            n_queries, queries = _flat(batch["queries"])
            n_docids, docids = _flat(batch["docids"])
            coded, gain, docids = queries.dictionary_encode(null_encoding="encode"), np.asarray(batch["gains"].flatten(), np.int64), np.asarray(docids, np.int64)
            code, names = np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()
            q_ends, d_ends = np.concatenate(([0], np.cumsum(n_queries))), np.concatenate(([0], np.cumsum(n_docids)))
            other = np.zeros(len(n_docids), bool)
            other[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
            cuts = [*np.flatnonzero(other).tolist(), len(n_docids)]
            begin = 0
            for end in cuts:
                if begin == end:
                    continue
                here = tuple(int(x[begin]) for x in keys)
                if here != key:
                    if key is not None:
                        added()
                        yield from best()
                    key, part = here, _Part()
                while begin < end:
                    to = min(end, max(begin + 1, int(np.searchsorted(d_ends, d_ends[begin] + WAITING, side="right")) - 1))
                    own = code[q_ends[begin] : q_ends[to]]
                    met, own = np.unique(own, return_inverse=True)
                    waiting.append((part.numbers([names[c] for c in met.tolist()])[own], gain[q_ends[begin] : q_ends[to]], n_queries[begin:to], docids[d_ends[begin] : d_ends[to]], n_docids[begin:to]))
                    held += int(d_ends[to] - d_ends[begin])
                    if held >= WAITING:
                        added()
                    begin = to
        if key is not None:
            added()
            yield from best()

    return run
