"""Approximate nearest neighbours by multi-index hashing, for the largest inner product.

Vectors become 64-bit codes: signs after a rotation that is learned (principal axes, then the rotation nearest to the corners of a cube) on
at most ``FIT`` vectors. A further coordinate makes up for the lengths of vectors, so that angles follow inner products. A code is cut
into four substrings of 16 bits, each with an index of its own. Two codes within radius r agree in one of the substrings to within that
substring's share of r (shares that sum to r - 3 suffice), so probing all values within the shares finds every code of the radius. Codes
found are verified, and their vectors ranked by inner product in double precision.

The radius is learned too: at most ``TRIAL`` query vectors are held against all vectors, and the radius is the least at which ``RECALL``
of their nearest come within it. A query that finds fewer than its number asks again with twice the radius, until it has them or has
seen all.

An index lies in groups of one substring and its first bits, cut into parts of about ``PART`` vectors by hash; a query goes only to groups
that can hold what it probes for. Equal vectors are one entry with the smallest ids of theirs (k + 1 suffice, as ties go to the smaller
id), so a vector that a third of all rows share is one entry, searched for once.

Odd input: rows without an id and vectors that are null, zero or hold null, NaN or infinite components take no part. Shorter vectors count as
filled with zeros at the end. Rows that repeat id and vector count once; an id of several vectors is a candidate with each, and as a query
has the nearest of all its vectors. A query is never its own neighbour. Fewer candidates than asked for are all returned. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import matrix, usable, widest

BITS, SUBSTRINGS, WIDTH = 64, 4, 16
#: Vectors that the rotation is learned on, and queries that the radius is learned on, with the share of their nearest that must lie within it.
FIT, TRIAL, RECALL = 10_000, 256, 0.97
#: Vectors in a part of a group, pairs of queries and codes that are verified at once, and pairs whose vectors are.
PART, CODES_AT_ONCE, VECTORS_AT_ONCE = 16_384, 1 << 20, 1 << 16
_ALL = np.arange(1 << WIDTH)
_ENTRY = "vector array<double>, code long, ids array<long>, entry long"
_FOUND = "query long, entry long, ids array<long>, score double"


class Codes:
    """The learned map from vectors to codes: lengths are divided by ``longest``."""

    def __init__(self, sample: np.ndarray, longest: float) -> None:
        self.longest = longest
        points = self._raised(sample)
        self.middle = points.mean(0)
        centred = points - self.middle
        axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
        turns = [_turned(centred @ axes, seed) for seed in range(-(-BITS // axes.shape[1]))]
        self.turn = np.concatenate([axes @ t for t in turns], 1)[:, :BITS]

    def _raised(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors of length one whose last coordinate stands for what they lack in length."""
        short = vectors / self.longest
        return np.concatenate((short, np.sqrt(np.maximum(0, 1 - (short**2).sum(1, keepdims=True)))), 1)

    def entries(self, vectors: np.ndarray) -> np.ndarray:
        return self._bits(self._raised(vectors))

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        own = vectors / np.abs(vectors).max(1, keepdims=True)
        own = own / np.sqrt((own**2).sum(1, keepdims=True))
        return self._bits(np.concatenate((own, np.zeros((len(own), 1))), 1))

    def _bits(self, points: np.ndarray) -> np.ndarray:
        return np.packbits((points - self.middle) @ self.turn > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _turned(points: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """A rotation after which points lie near the corners of a cube; rounds alternate between corners and the rotation that fits them best."""
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(points.shape[1],) * 2))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(points.T @ np.where(points @ turn > 0, 1.0, -1.0))
        turn = left @ right
    return turn


def shares(radius: int) -> list[int]:
    """How many bits may differ in each substring: codes within the radius keep to at least one of these. Below 0 a substring needs no look."""
    left = radius - SUBSTRINGS + 1
    return [min(WIDTH, left // SUBSTRINGS + (s < left % SUBSTRINGS)) for s in range(SUBSTRINGS)]


def substring(codes: np.ndarray, s: int) -> np.ndarray:
    return ((codes >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Group:
    """The entries of one part of a group: vectors, and their places by the value of the substring."""

    def __init__(self, s: int, rows: pa.Table, width: int) -> None:
        self.s = s
        codes = np.asarray(rows["code"]).astype(np.uint64)
        own = substring(codes, s)
        order = np.argsort(own, kind="stable")
        self.codes, self.vectors = codes[order], matrix(rows["vector"].combine_chunks(), width)[order]
        self.rows = rows.select(["entry", "ids"]).combine_chunks().take(pa.array(order))
        self.first_id = np.asarray(pc.list_element(self.rows["ids"], 0))
        self.values, self.start = np.unique(own[order], return_index=True)
        self.size = np.diff(np.append(self.start, len(order)))

    def candidates(self, codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place of the query, place of the entry) within the radius that no earlier substring finds.

        The values that occur are looked through where they are fewer than those to probe; both give the same buckets.
        """
        share, own = shares(radius), substring(codes, self.s)
        if share[self.s] < 0:
            return
        near = _ALL[np.bitwise_count(_ALL) <= share[self.s]]
        by_value = np.full(1 << WIDTH, -1)
        by_value[self.values] = np.arange(len(self.values))
        at_once = max(1, CODES_AT_ONCE // max(1, len(self.codes)))
        for begin in range(0, len(codes), at_once):
            part = own[begin : begin + at_once]
            if len(self.values) < len(near):
                query, bucket = np.nonzero(np.bitwise_count(part[:, None] ^ self.values) <= share[self.s])
            else:
                bucket = by_value[part[:, None] ^ near].ravel()
                query = np.repeat(np.arange(len(part)), len(near))[bucket >= 0]
                bucket = bucket[bucket >= 0]
            entry = _ranges(self.start[bucket], self.size[bucket])
            query = np.repeat(query, self.size[bucket]) + begin
            apart = codes[query] ^ self.codes[entry]
            good = np.bitwise_count(apart) <= radius
            for s in range(self.s):
                good &= np.bitwise_count(substring(apart, s)) > share[s]
            yield query[good], entry[good]

    def best(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, radius: int, k: int) -> Iterator[pa.RecordBatch]:
        """The k nearest entries of each query among those within the radius; ties go to the smaller id."""
        for query, entry in self.candidates(codes, radius):
            score = np.concatenate([np.einsum("ij,ij->i", vectors[query[i : i + VECTORS_AT_ONCE]], self.vectors[entry[i : i + VECTORS_AT_ONCE]]) for i in range(0, len(query), VECTORS_AT_ONCE)] or [np.zeros(0)])
            order = np.lexsort((self.first_id[entry], -score, query))
            query, entry, score = query[order], entry[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            kept = place < k
            own = self.rows.take(pa.array(entry[kept])).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(ids[query[kept]]), own["entry"].combine_chunks(), own["ids"].combine_chunks(), pa.array(score[kept])], names=["query", "entry", "ids", "score"])


def nearest_neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows that are found for each row whose id is divisible by ``every``."""
    rows = embeddings.select(embeddings[id_col].cast("long").alias("vec_id"), embeddings[vector_col].cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"), math.inf) & F.exists("vector", lambda x: x != 0))
    width = widest(rows)
    zeros = F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size("vector"), F.lit(0)))
    rows = rows.withColumn("vector", F.concat("vector", zeros)).distinct()
    entries = _entries(rows, k)
    asked = checkpointed(rows.where(F.col("vec_id") % every == 0).join(entries.select("vector", "entry"), "vector").select("vec_id", "entry"))
    codes, radius = _learned(entries, asked, width, k)
    indexed = checkpointed(_coded(entries, codes, width))
    todo = _query_codes(indexed, asked, codes, width)
    index, sizes = _index(indexed)
    held: DataFrame | None = None
    while True:
        found = checkpointed(_best_ids(_searched(index, sizes, todo, radius, width, k), k))
        held = found if held is None else held.unionByName(found)
        if radius >= BITS:
            break
        # k + 1 ids in all, one of which may be the query's own
        short = todo.join(found.where(F.size("best") > k).select("query"), "query", "left_anti")
        if short.isEmpty():
            break
        radius, todo = min(BITS, 2 * radius), checkpointed(short)
        held = held.join(todo.select("query"), "query", "left_anti")
    each = asked.join(held, F.col("entry") == F.col("query")).select(F.col("vec_id").alias("query_id"), F.explode("best").alias("hit"))
    others = each.where("hit.id <> query_id").select("query_id", F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(entry, vector, ids): distinct vectors with their k + 1 smallest ids; a task passes on no more ids of a vector than these."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    return checkpointed(few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.monotonically_increasing_id()))


def _array(rows: list, width: int) -> np.ndarray:
    return np.array([r.vector for r in rows], np.float64).reshape(len(rows), width)


def _learned(entries: DataFrame, asked: DataFrame, width: int, k: int) -> tuple[Codes, int]:
    """Rotation and radius, from samples of fixed size that a hash chooses."""
    by_hash = F.xxhash64("ids", "vector")
    longest = entries.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 1.0
    sample = _array(entries.orderBy(by_hash).limit(FIT).select("vector").collect(), width)
    codes = Codes(sample if len(sample) else np.zeros((1, width)), longest)
    trial = entries.join(asked.select("entry").distinct(), "entry", "left_semi").orderBy(by_hash).limit(TRIAL).select("entry", "vector").collect()
    if not trial:
        return codes, BITS
    queries, own = _array(trial, width), np.array([r.entry for r in trial])
    bits = codes.queries(queries)

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, apart = np.zeros((len(own), 0)), np.zeros((len(own), 0), np.int64)
        for batch in batches:
            vectors = matrix(batch["vector"], width)
            here = np.where(own[:, None] == np.asarray(batch["entry"]), -np.inf, queries @ vectors.T)
            score = np.concatenate((score, here), 1)
            apart = np.concatenate((apart, np.bitwise_count(bits[:, None] ^ codes.entries(vectors)).astype(np.int64)), 1)
            best = np.argsort(-score, 1, kind="stable")[:, :k]
            score, apart = np.take_along_axis(score, best, 1), np.take_along_axis(apart, best, 1)
        query = np.repeat(np.arange(len(own)), score.shape[1])
        there = np.isfinite(score.ravel())
        yield pa.RecordBatch.from_pydict({"query": query[there], "score": score.ravel()[there], "apart": apart.ravel()[there]})

    near = entries.select("entry", "vector").mapInArrow(closest, "query long, score double, apart long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "apart"))
    counts = near.withColumn("place", place).where(F.col("place") <= k).groupBy("apart").count().orderBy("apart").collect()  # a row a distance, 65 at most
    reached, total = 0, sum(r["count"] for r in counts)
    for r in counts:
        reached += r["count"]
        if reached >= RECALL * total:
            return codes, max(SUBSTRINGS, r.apart)
    return codes, BITS


def _coded(entries: DataFrame, codes: Codes, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codes.entries(matrix(batch["vector"], width)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["vector"], pa.array(own), batch["ids"], batch["entry"]], names=["vector", "code", "ids", "entry"])

    return entries.select("vector", "ids", "entry").mapInArrow(run, _ENTRY)


def _query_codes(entries: DataFrame, asked: DataFrame, codes: Codes, width: int) -> DataFrame:
    """(query, vector, code): entries that are asked for, with their codes as queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codes.queries(matrix(batch["vector"], width)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["entry"], batch["vector"], pa.array(own)], names=["query", "vector", "code"])

    chosen = entries.join(asked.select("entry").distinct(), "entry", "left_semi")
    return checkpointed(chosen.select("entry", "vector").mapInArrow(run, "query long, vector array<double>, code long"))


def _head(code: Column, s: int, bits: int) -> Column:
    """The first bits of a substring."""
    return F.shiftright(code, s * WIDTH + WIDTH - bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _index(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries once for each substring, with their group and part; and (s, head, parts), at most a row for each of 4 * 2**16 groups."""
    bits = min(WIDTH, max(0, math.ceil(math.log2(max(1, entries.count()) / PART))))
    every = F.array(*(F.struct(F.lit(s).alias("s"), _head(F.col("code"), s, bits).alias("head")) for s in range(SUBSTRINGS)))
    placed = entries.withColumn("g", F.explode(every)).select("*", "g.s", "g.head").drop("g")
    sizes = checkpointed(placed.groupBy("s", "head").agg(F.ceil(F.count("*") / PART).alias("parts")).withColumn("bits", F.lit(bits)))
    index = placed.join(F.broadcast(sizes), ["s", "head"]).withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")))
    return index.drop("parts", "bits"), sizes


def _searched(index: DataFrame, sizes: DataFrame, queries: DataFrame, radius: int, width: int, k: int) -> DataFrame:
    """(query, entry, ids, score): the best k + 1 entries of each query in each part of a group that it visits.

    Parts and their queries meet in one task, sorted so that a part's entries come first and its queries stream past them.
    """
    bits = (sizes.select("bits").first() or [0])[0]
    near = lambda most: F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda m: F.bit_count(m) <= most)
    of = lambda s, most: F.transform(near(most), lambda m: F.struct(F.lit(s).alias("s"), _head(F.col("code"), s, bits).bitwiseXOR(m).alias("head")))
    heads = [of(s, most) for s, most in enumerate(shares(radius)) if most >= 0]
    visits = queries.select("query", "vector", "code", F.explode(F.concat(*heads)).alias("g")).select("query", "vector", "code", "g.*").join(F.broadcast(sizes), ["s", "head"])
    visits = visits.select("s", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "vector", "code", F.lit(None).cast("array<long>").alias("ids"), F.col("query").alias("entry"), F.lit(1).alias("asks"))
    rows = index.select("s", "head", "part", "vector", "code", "ids", "entry", F.lit(0).alias("asks")).unionByName(visits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, group = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch[c]).astype(np.int64) for c in ("s", "head", "part", "asks")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                rows, (*own, asks) = batch.slice(begin, end - begin), keys[begin].tolist()
                if own != key:
                    key, waiting, group = own, [], None
                if not asks:
                    waiting.append(rows)
                elif waiting or group:
                    if group is None:
                        group, waiting = Group(own[0], pa.Table.from_batches(waiting), width), []
                    yield from group.best(np.asarray(rows["entry"]), matrix(rows["vector"], width), np.asarray(rows["code"]).astype(np.uint64), radius, k + 1)

    where = ["s", "head", "part"]
    return rows.repartition(*where).sortWithinPartitions(*where, "asks").mapInArrow(run, _FOUND)


def _best_ids(found: DataFrame, k: int) -> DataFrame:
    """(query, best): the k + 1 nearest ids of each query entry, its own among them."""
    by_entry = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    few = found.withColumn("place", F.row_number().over(by_entry)).where(F.col("place") <= k + 1)
    each = few.select("query", "score", F.explode("ids").alias("id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    cut = each.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    return cut.groupBy("query").agg(F.collect_list(F.struct("id", "score")).alias("best"))
