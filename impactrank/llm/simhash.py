"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

A fingerprint has 64 bits by majority vote over the XXH64 hashes of a document's word shingles. Two
fingerprints within ``radius`` bits must agree within t_i bits in some part i of the bits whenever
the sum of (t_i + 1) over the parts is radius + 1. Correlated bits are grouped into parts, and
dynamic programming gives the parts unequal thresholds at the least estimated cost. For a threshold
t, a part is probed by masking every choice of t of its bits: two values within t bits share a masked value.

All copies of one fingerprint are one node, so a hot group costs a row. A bucket gives a spanning
forest of its verified links, never all pairs; buckets over ``BUCKET`` rows are dealt out again in
blocks, every pair of blocks to its own task, so no group must fit one task and none is capped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_text, lean, mix, slices, text_bytes, words

#: Fingerprints of a bucket that one task compares directly.
BUCKET = 4096
#: Fingerprints that the cost estimates look at. They steer cost alone: links are exact for any estimate.
ESTIMATE = 2048
#: Rows that a task of a narrow table has at least, where the table needs more tasks than there are cores; links up to which nodes are sent to them.
TASK_ROWS, SENT_LINKS = 1 << 14, 1 << 17
SEED = 42
_U = np.uint64


def fingerprint(text: bytes, n_words: int = 4) -> int:
    """Of one text: a bit is 1 if set in over half the shingle hashes; no words give zero."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= n_words:
        return digest(b" ".join(tokens), SEED)
    whole = b" ".join(tokens)
    ends = list(itertools.accumulate(map(len, tokens), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[n_words - 1 :])], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null and blank texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, n_words) for t in text_bytes(batch["text"])), _U, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, the most correlated ones together."""
    bits = ((sample[:, None] >> np.arange(64, dtype=_U)) & _U(1)).astype(float)
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    likeness = np.abs(centred.T @ centred / np.outer(spread, spread))
    np.fill_diagonal(likeness, 0)
    free, out = set(range(64)), []
    for i in range(parts):
        size = (64 * (i + 1)) // parts - (64 * i) // parts
        left = sorted(free)
        own = [left[int(np.argmax(likeness[np.ix_(left, left)].max(axis=1)))]]
        free.remove(own[0])
        while len(own) < size:
            left = sorted(free)
            own.append(left[int(np.argmax(likeness[np.ix_(left, own)].sum(axis=1)))])
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def masks_of(bits: list[int], threshold: int) -> list[int]:
    """Masks that keep a part's bits but for every choice of ``threshold`` of them."""
    full = sum(1 << b for b in bits)
    return [full & ~sum(1 << b for b in gone) for gone in itertools.combinations(bits, threshold)]


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum(t + 1) = radius + 1. ``costs[i][t + 1]``: of part i at threshold t; -1 leaves it out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for spend, c in enumerate(cost):
                if used + spend <= radius + 1 and (used + spend not in step or total + c < step[used + spend][0]):
                    step[used + spend] = (total + c, [*chosen, spend - 1])
        best = step
    return best[radius + 1]


def plan_masks(sample: np.ndarray, n: int, radius: int) -> list[int]:
    """The cheapest set of masks such that fingerprints within ``radius`` bits agree under one of them.

    A row to be dealt counts as 50 comparisons. Comparisons are estimated from the pairs of the sample.
    """
    from math import comb

    scale = (n / max(1, len(sample))) ** 2 / 2
    found: tuple[float, list[int]] | None = None
    for parts in range(1, radius + 2):
        groups = group_bits(sample, parts) if len(sample) > 1 else [list(range(64 * i // parts, 64 * (i + 1) // parts)) for i in range(parts)]
        costs = []
        for bits in groups:
            full = _U(sum(1 << b for b in bits))
            own = sample & full
            near = np.bincount(np.concatenate([np.bitwise_count(own[i : i + 256, None] ^ own[None, :]).ravel() for i in range(0, len(own), 256)] or [np.zeros(0, np.uint8)]), minlength=4)[:4].astype(float)
            near[0] = max(0.0, near[0] - len(sample))
            near += len(sample) ** 2 / 2.0 ** len(bits) * np.array([comb(len(bits), d) for d in range(4)])
            cost = [0.0]
            for t in range(min(3, len(bits) + 1)):
                pairs = sum(near[d] * comb(len(bits) - d, t - d) for d in range(t + 1))
                cost.append(50.0 * n * comb(len(bits), t) + scale * pairs)
            costs.append(cost)
        if sum(len(c) - 1 for c in costs) >= radius + 1:
            total, chosen = allocate(costs, radius)
            if found is None or total < found[0]:
                found = total, [m for bits, t in zip(groups, chosen) if t >= 0 for m in masks_of(bits, t)]
    assert found
    return found[1]


def forest(values: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links within ``radius`` bits among the values of one bucket, and links between neighbouring branches; under two links a value."""
    left, a, b = values, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                got = left[near]
                a += [np.full(len(got), at), got[:-1][np.bitwise_count(got[1:] ^ got[:-1]) <= radius]]
                b += [got, got[1:][np.bitwise_count(got[1:] ^ got[:-1]) <= radius]]
                queue.extend(got)
                left = left[~near]
    return a, b


def _bucket_links(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of sorted keys."""
    a, b = [], []
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edges)
    small = np.repeat(sizes <= 8, sizes)
    for lag in range(1, min(8, int(sizes.max()))):
        same = (keys[lag:] == keys[:-lag]) & small[lag:]
        near = same & (np.bitwise_count(values[lag:] ^ values[:-lag]) <= radius)
        a.append(values[:-lag][near])
        b.append(values[lag:][near])
    for i in np.flatnonzero(sizes > 8):
        x, y = forest(np.unique(values[edges[i] : edges[i + 1]]), radius)
        a += x
        b += y
    none = [np.zeros(0, _U)]
    x, y = np.concatenate(a or none), np.concatenate(b or none)
    keep = x != y
    return x[keep], y[keep]


def _links_of_runs(radius: int, most: int | None):
    """A function over batches sorted by key: rows (a, b) are links; rows with ``key`` are of buckets over ``most``, put off."""

    def rows(a, b, key=None):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)) if b is not None else none, pa.array(key.view(np.int64)) if key is not None else none], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, large = np.zeros(0, np.int64), np.zeros(0, _U), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                more, held = batch["key"].to_numpy(zero_copy_only=False), batch["fp"].to_numpy(zero_copy_only=False).view(_U)
                if large is not None and (n := int((more == large).sum())):
                    yield rows(held[:n], None, more[:n])
                    more, held = more[n:], held[n:]
                keys, values = np.concatenate((keys, more)), np.concatenate((values, held))
            if not len(keys):
                continue
            cut = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
            own, held, keys, values = keys[:cut], values[:cut], keys[cut:], values[cut:]
            if len(own) and most:
                sizes = np.diff(np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True]))))
                big = np.repeat(sizes > most, sizes)
                if big.any():
                    yield rows(held[big], None, own[big])
                    own, held = own[~big], held[~big]
            if len(own):
                a, b = _bucket_links(own, held, radius)
                if len(a):
                    yield rows(np.minimum(a, b), np.maximum(a, b))
            if most and len(keys) > most:
                large = keys[-1]
                yield rows(values, None, keys)
                keys, values = keys[:0], values[:0]

    return run


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within ``radius`` bits do. ``nodes``: distinct ``fp``."""
    n = nodes.count()
    tasks = tasks_for(nodes, n)
    nodes = nodes.coalesce(tasks)
    sample = np.array([r.fp for r in nodes.orderBy(F.xxhash64("fp")).limit(ESTIMATE).collect()], np.int64).view(_U)
    masks = np.array(plan_masks(sample, n, radius), _U)
    salts = (np.arange(1, len(masks) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch["fp"].to_numpy(zero_copy_only=False).view(_U)
            for i in range(0, len(values), 2000):
                part = values[i : i + 2000]
                keys = (part[:, None] & masks) * _U(0xD6E8FEB86659FD93) + salts  # odd factors keep masked values apart
                keys ^= keys >> _U(29)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], ["key", "fp"])

    dealt = nodes.select("fp").mapInArrow(lean(probes), "key long, fp long")
    first = checkpointed(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_links_of_runs(radius, BUCKET)), "a long, b long, key long").coalesce(tasks_for(nodes, n * len(masks))))
    found = first.where("b is not null").select("a", "b")
    late = first.where("b is null").select("key", F.col("a").alias("fp"))
    blocks = late.groupBy("key").agg(F.ceil(F.count("*") / (BUCKET // 2)).alias("n"))
    if not blocks.isEmpty():
        cut = late.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")))
        pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        found = found.unionByName(pairs.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_links_of_runs(radius, None)), "a long, b long, key long").select("a", "b"))
    return found.distinct().coalesce(tasks)


def tasks_for(df: DataFrame, rows: int) -> int:
    """As many tasks as the session has cores, or as ``rows`` need: a small table in more partitions costs more to start than to compute."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, by alternating large-star and small-star steps, checkpointed each round.

    Each step gives every node a least neighbour. Of up to ``SENT_LINKS`` links these are sent to the links, else they meet by a shuffle.
    """
    edges = checkpointed(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    mark, n = None, edges.count()
    while True:
        tasks, few = tasks_for(edges, n), n <= SENT_LINKS
        sent = lambda told: F.broadcast(told.coalesce(tasks)) if few else told  # noqa: B023, E731
        both = edges.coalesce(tasks).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(sent(least), "u").where("v > u").select(F.col("m").alias("u"), "v")
        large = large if few else large.distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(sent(low), "v").select(F.col("m").alias("x"), F.explode(F.array("u", "v")).alias("y")).where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()
        edges = checkpointed(small.coalesce(tasks))
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that links can reach, itself included.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows
    stay, each with its result. A null id is no candidate for a component's name; a component of
    null ids alone is named null. An empty table gives an empty result. Other columns are ignored.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, n_words))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(nodes, radius))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = checkpointed(named.groupBy("root").agg(F.min("least_id").alias("component_id")))
    member = checkpointed(named.join(names, "root").select("fp", "component_id"))
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")


#: Fingerprints over words that name candidates, each by word hashes of its own.
PRINTS = 2
#: Bytes of shingle hashes in a block of a group; a task compares two blocks.
BLOCK_BYTES = 8 << 20


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints over the distinct words of each text.

    Words as features keep the fingerprints of near copies within few bits, where shingles of several
    words would move them apart; the shingles decide afterwards.
    """
    for batch in batches:
        texts, prints = text_bytes(batch["text"]), []
        for i, j in slices(texts):
            w = words(texts[i:j], lower=True)
            for k in range(j - i):
                own = np.unique(w.hash[w.first[k] : w.first[k + 1]])
                row = []
                for s in range(PRINTS):
                    hashes = (mix(own + _U(s)) if s else own).astype("<u8")
                    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
                    row.append(int(np.packbits(2 * bits > len(own), bitorder="little").view("<i8")[0]))
                prints.append(row)
        cols = [pa.array([r[s] for r in prints], pa.int64()) for s in range(PRINTS)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["same"], *cols], ["doc_id", "same", *(f"fp{s}" for s in range(PRINTS))])


def _shingled(n_words: int):
    """The distinct shingle hashes of each text; a text without words has the one hash 0, so that such texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own.tobytes() for own in _sets(text_bytes(batch["text"]), n_words)]
            yield pa.RecordBatch.from_arrays([batch["grp"], batch["pivot"], batch["id"], pa.array(sets, pa.binary())], ["grp", "pivot", "id", "shingles"])

    return run


def _beside_pivot(least: float):
    """Marks the texts that are similar to the pivot of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch["shingles"].to_pylist(), batch["hub"].to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True))
                alike.append(both * (1 + least) >= least * (len(x) + len(y)) / 8 - 1e-9)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("grp", "pivot", "id", "shingles")), pa.array(alike, pa.bool_())], ["grp", "pivot", "id", "shingles", "alike"])

    return run


def similar_links(ids: np.ndarray, sets: list[np.ndarray], joined: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Links that join the same texts as all pairs of similarity ``least`` do. Texts flagged in ``joined`` are in one component already."""
    n, size = len(sets), np.array([len(s) for s in sets])
    begin = np.concatenate(([0], np.cumsum(size)))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(n), size)[np.argsort(codes, kind="stable")]
    place = np.concatenate(([0], np.cumsum(np.bincount(codes))))
    left, apart = np.ones(n, bool), True
    a: list[int] = []
    b: list[int] = []
    for first in np.flatnonzero(~joined):
        queue = [int(first)] if left[first] else []
        left[first] = False
        while queue and left.any():
            at = queue.pop()
            own = codes[begin[at] : begin[at + 1]]
            many = place[own + 1] - place[own]
            shared = np.bincount(holder[np.repeat(place[own] - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=n)
            got = np.flatnonzero(left & (shared * (1 + least) >= least * (size[at] + size) - 1e-9))
            a += [int(ids[at])] * len(got)
            b += ids[got].tolist()
            left[got] = False
            queue += got.tolist()
            if apart and joined[got].any():
                apart, rest = False, np.flatnonzero(left & joined)
                left[rest] = False
                queue += rest.tolist()
    return a, b


def _links_of_blocks(least: float):
    """Links inside the runs of one key, from batches sorted by key."""

    def close(rows: list[tuple]) -> pa.RecordBatch:
        a, b = similar_links(np.array([r[1] for r in rows], np.int64), [np.frombuffer(r[2], _U) for r in rows], np.array([r[3] for r in rows], bool), least)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "id", "shingles", "alike"))):
                if rows and rows[0][0] != row[0]:
                    yield close(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield close(rows)

    return run


def candidate_groups(texts: DataFrame, radius: int) -> DataFrame:
    """(id, same, grp, pivot) of all texts; grp is shared by texts that some fingerprint links. The pivot, null where a text is alone, is a text of the group's commonest fingerprint."""
    edges: DataFrame | None = None
    n = texts.count()
    tasks = tasks_for(texts, n)
    texts = texts.coalesce(tasks)
    sent = lambda told: F.broadcast(told) if n <= SENT_LINKS else told
    for s in range(PRINTS):
        leaders = checkpointed(texts.groupBy(F.col(f"fp{s}").alias("fp")).agg(F.min("id").alias("leader")).coalesce(tasks))
        within = texts.join(sent(leaders), texts[f"fp{s}"] == leaders.fp).where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
        named = lambda side, leaders=leaders: leaders.select(F.col("fp").alias(side), F.col("leader").alias(f"{side}_id"))
        between = links(leaders, radius).join(sent(named("a")), "a").join(sent(named("b")), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
        edges = within.unionByName(between) if edges is None else edges.unionByName(within).unionByName(between)
    assert edges is not None
    roots = components(edges)
    near = checkpointed(texts.join(roots, texts.id == roots.node, "left").select("id", "same", "fp0", F.coalesce("root", "id").alias("grp")).coalesce(tasks))
    prints = near.groupBy("grp", "fp0").agg(F.count("*").alias("n"), F.max(-F.col("id")).alias("late"))
    pivots = prints.groupBy("grp").agg(F.sum("n").alias("n"), F.max(F.struct("n", "late")).alias("most")).where("n > 1")
    return checkpointed(near.join(pivots.select("grp", (-F.col("most.late")).alias("pivot")), "grp", "left").select("id", "same", "grp", "pivot").coalesce(tasks))


#: Texts, about, whose shingles tell which ones are common, and common ones kept. They steer cost alone.
COMMON_TEXTS, COMMON = 4096, 50_000
#: Cells in which shingles are counted; parities of the counts, and for longer texts the counts, tell most pairs apart before their sets are compared.
CELLS = 2048
#: Comparisons of a bucket of shared shingles that one task makes directly.
SHARED = 1 << 24


def _sets(texts: list[bytes], n_words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, rising; a text without words has the one hash 0."""
    for i, j in slices(texts):
        hashes, doc = words(texts[i:j], lower=True).shingles(n_words)
        ends = np.searchsorted(doc, np.arange(j - i + 1))
        for a, b in zip(ends[:-1], ends[1:]):
            yield np.unique(hashes[a:b]) if b > a else np.zeros(1, _U)


def common_shingles(texts: DataFrame, n: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of ``n`` texts hold, rising, and how many hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _sets(text_bytes(batch["text"]), n_words):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["key"])

    part = texts.where(F.pmod(F.xxhash64("same"), F.lit(max(1, n // COMMON_TEXTS))) == 0).select("text")
    found = part.mapInArrow(lean(run), "key long").groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(COMMON).collect()
    keys = np.array([r["key"] for r in found], np.int64).view(_U)
    order = np.argsort(keys)
    return keys[order], np.array([r["count"] for r in found], np.int64)[order]


def _prefixes(n_words: int, least: float, known):
    """Of each text the shingles of which every similar text shares one, rarest first, how many it has in all, the parities of their numbers in ``CELLS`` cells, and the numbers where there are more shingles than cells.

    A text of n shingles shares least * n or more with a similar one, so under one order of all
    shingles the first n - ceil(least * n) + 1 of both have a shingle in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = known.value
        for batch in batches:
            first, size, odd, cells = [], [], [], []
            for own in _sets(text_bytes(batch["text"]), n_words):
                held = np.bincount((mix(own) % _U(CELLS)).astype(np.int64), minlength=CELLS)
                odd.append(np.packbits((held & 1).astype(bool)).tobytes())
                cells.append(held.astype(np.uint8 if held.max() < 256 else "<u4").tobytes() if len(own) > CELLS else None)
                weight = np.zeros(len(own), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    weight = np.where(common[at] == own, counts[at], 0)
                keep = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
                first.append(own[np.argsort(weight, kind="stable")[:keep]].tobytes())
                size.append(len(own))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["same"], pa.array(size, pa.int64()), pa.array(first, pa.binary()), pa.array(odd, pa.binary()), pa.array(cells, pa.binary())], ["doc_id", "same", "n", "first", "odd", "cells"])

    return run


_SHARED = ["key", "id", "grp", "at"]


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a prefix; ``at`` holds the text's size above the shingle's place, which has 32 bits."""
    for batch in batches:
        keys = [np.frombuffer(x, np.int64) for x in batch["first"].to_pylist()]
        many = np.array([len(k) for k in keys], np.int64)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ids, groups, sizes = (np.repeat(batch[c].to_numpy(zero_copy_only=False), many) for c in ("id", "grp", "n"))
        cols = [np.concatenate(keys or [np.zeros(0, np.int64)]), ids, groups, (sizes << 32) + place]
        for i in range(0, len(place), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000], pa.int64()) for c in cols], _SHARED)


def _may_be_alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Of rows (key, id, group, size, place) that share a shingle: whether it can be the first that similar texts of two groups share."""
    rest = np.minimum(x[3] - x[4], y[3] - y[4])
    return (x[2] != y[2]) & (rest * (1 + least) >= least * (x[3] + y[3]) - 1e-9)


def _pairs_of_runs(least: float, most: int | None):
    """Pairs (a, b) inside the runs of one key, from batches sorted by key; rows with a key are of buckets over ``most`` comparisons, put off."""

    def rows(x: np.ndarray, y: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(x.shape[1], pa.int64())
        got = [x[1], x[2], none, none, none, none, none] if y is None else [x[1], x[2], y[1], y[2], none, none, none]
        if y is None:
            got[4:] = [x[0], x[3], x[4]]
        else:
            swap = x[1] > y[1]
            got[:4] = [np.where(swap, p, q) for p, q in ((y[1], x[1]), (y[2], x[2]), (x[1], y[1]), (x[2], y[2]))]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in got], ["a", "a_grp", "b", "b_grp", "key", "n", "place"])

    def close(own: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.concatenate(([True], own[0, 1:] != own[0, :-1])))
        mixed = np.minimum.reduceat(own[2], edges) < np.maximum.reduceat(own[2], edges)
        own = own[:, np.repeat(mixed, np.diff(np.append(edges, own.shape[1])))]
        if not own.shape[1]:
            return
        edges = np.flatnonzero(np.concatenate(([True], own[0, 1:] != own[0, :-1], [True])))
        sizes = np.diff(edges)
        small = np.repeat(sizes <= 8, sizes)
        for lag in range(1, min(8, int(sizes.max()))):
            x, y = own[:, :-lag], own[:, lag:]
            near = (x[0] == y[0]) & small[lag:] & _may_be_alike(x, y, least)
            if near.any():
                yield rows(x[:, near], y[:, near])
        for i in np.flatnonzero(sizes > 8):
            part = own[:, edges[i] : edges[i + 1]]
            _, group, count = np.unique(part[2], return_inverse=True, return_counts=True)
            odd = group != np.argmax(count)
            if most and int(odd.sum()) * part.shape[1] > most:
                yield rows(part, None)
                continue
            part, n_odd = part[:, np.argsort(~odd, kind="stable")], int(odd.sum())
            for k in range(n_odd):
                near = np.flatnonzero(_may_be_alike(part[:, k : k + 1], part[:, k + 1 :], least)) + k + 1
                if len(near):
                    yield rows(np.repeat(part[:, k : k + 1], len(near), axis=1), part[:, near])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            *own, at = (batch[c].to_numpy(zero_copy_only=False) for c in _SHARED)
            own = np.stack([*own, at >> 32, at & 0xFFFFFFFF])
            if not own.shape[1]:
                continue
            if held and own[0, -1] == held[0][0, -1]:
                held.append(own)
                continue
            cut = int(np.searchsorted(own[0], own[0, -1]))
            yield from close(np.concatenate([*held, own[:, :cut]], axis=1)) if held or cut else ()
            held = [own[:, cut:]]
        if held:
            yield from close(np.concatenate(held, axis=1))

    return run


def _parities_allow(least: float):
    """The pairs that parities leave open: sets differ in as many shingles as parities do, or more, so no similar pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), _U).reshape(batch.num_rows, -1) for c in ("x", "y"))
                n = batch["x_n"].to_numpy() + batch["y_n"].to_numpy()
                near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * (1 + least) <= (1 - least) * n + 1e-9
                yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _counts_allow(least: float):
    """The pairs that counts by cell leave open: sets differ in as many shingles as counts do together, or more. Pairs of which a text has no counts stay."""
    counts = lambda b: np.frombuffer(b, np.uint8 if len(b) == CELLS else "<u4").astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y, m, n in zip(*(batch[c].to_pylist() for c in ("x", "y", "x_n", "y_n"))):
                near.append(x is None or y is None or np.abs(counts(x) - counts(y)).sum() * (1 + least) <= (1 - least) * (m + n) + 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _alike(least: float):
    """The pairs whose shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True))
                same.append(both * (1 + least) >= least * (len(x) + len(y)) / 8 - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return run


def pairs_across(own: DataFrame, member: DataFrame, n_words: int, least: float) -> DataFrame:
    """(a, b): texts of two groups of ``member`` (id, same, grp) that may be similar, every pair that is among them.

    All pairs of texts of two groups that share a shingle of their prefixes and whose sizes and places allow the
    similarity are looked at, and those stay whose parities do. Pairs inside a group are never made.
    """
    n = member.count()
    known = own.sparkSession.sparkContext.broadcast(common_shingles(own, n, n_words))
    told = own.mapInArrow(lean(_prefixes(n_words, least, known)), "doc_id long, same string, n long, first binary, odd binary, cells binary")
    first = checkpointed(told.join(member.select(F.col("name").alias("doc_id"), "same", "id", "grp"), ["doc_id", "same"]).dropDuplicates(["doc_id", "same"]).select("id", "grp", "n", "first", "odd", "cells").coalesce(tasks_for(member, 8 * n)))
    shape, out = "key long, id long, grp long, at long", "a long, a_grp long, b long, b_grp long, key long, n long, place long"
    made = checkpointed(first.mapInArrow(lean(_dealt), shape).repartition("key").sortWithinPartitions("key").mapInArrow(lean(_pairs_of_runs(least, SHARED)), out))
    pairs = made.where("b is not null").select("a", "b")
    late = made.where("b is null").select("key", F.col("a").alias("id"), F.col("a_grp").alias("grp"), "n", "place")
    blocks = late.groupBy("key").agg(F.ceil(F.count("*") / (BUCKET // 2)).alias("blocks"))
    if not blocks.isEmpty():
        cut = late.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        again = cut.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "grp", (F.shiftleft("n", 32) + F.col("place")).alias("at"))
        pairs = pairs.unionByName(again.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_pairs_of_runs(least, None)), out).select("a", "b"))
    pairs = checkpointed(pairs.distinct())
    pairs = pairs.coalesce(tasks_for(pairs, pairs.count()))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    odd = checkpointed(first.select("id", "n", "odd", "cells").join(ids, "id", "left_semi").coalesce(tasks_for(member, 8 * n)))
    for told_by, test in (("odd", _parities_allow(least)), ("cells", _counts_allow(least))):
        tell = lambda name, held: odd.select(F.col("id").alias(name), F.col("n").alias(f"{held}_n"), F.col(told_by).alias(held))  # noqa: B023, E731
        pairs = checkpointed(pairs.join(tell("a", "x"), "a").join(tell("b", "y"), "b").mapInArrow(lean(test), "a long, b long"))
    return pairs


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, least: float = 0.8, radius: int = 8) -> DataFrame:
    """(name, same, chief) of each distinct text: the smallest id that has it, its MD5, and the (name, same) that comes first in its group.

    Groups are those of all pairs of shingle similarity ``least`` or more, linked through others or not. ``PRINTS`` fingerprints that are
    within ``radius`` bits name most candidates; texts that candidates join make a group, in which exact shingle sets decide on every pair that may still matter.
    First all members meet their group's pivot. Those that differ from it then meet all others, in pairs of blocks of bounded
    size, so that a group of any size is whole and none must fit a task. Similar texts whose fingerprints lie further apart (a section added or
    cut off) are found by ``pairs_across``; the fingerprints save it the pairs inside large groups. A text without words is similar to another such one alone. Rows without an id are left out.
    """
    own = id_text(docs, id_col, text_col).where("doc_id is not null").withColumn("same", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = own.mapInArrow(lean(_printed), "doc_id long, same string" + "".join(f", fp{s} long" for s in range(PRINTS)))
    texts = rows.groupBy("same").agg(F.min("doc_id").alias("name"), *(F.min(f"fp{s}").alias(f"fp{s}") for s in range(PRINTS)))
    texts = checkpointed(texts.withColumn("id", F.monotonically_increasing_id()))  # the checkpoint fixes the numbers
    members = candidate_groups(texts, radius)
    n = texts.count()
    tasks, wide = tasks_for(texts, n), tasks_for(texts, 8 * n)
    member = checkpointed(members.join(texts.select("id", "name").coalesce(tasks), "id").coalesce(tasks))
    apart = pairs_across(own, member, n_words, least)
    loose = checkpointed(apart.select(F.col("a").alias("id")).union(apart.select("b")).distinct().coalesce(tasks))
    loose = F.broadcast(loose) if n <= SENT_LINKS else loose
    held = member.where("pivot is not null").unionByName(member.where("pivot is null").join(loose, "id", "left_semi"))
    found = own.join(held.withColumnRenamed("name", "doc_id"), ["doc_id", "same"]).groupBy("doc_id", "same").agg(*(F.first(c).alias(c) for c in ("grp", "pivot", "id", "text")))
    sets = checkpointed(found.select("grp", "pivot", "id", "text").mapInArrow(lean(_shingled(n_words)), "grp long, pivot long, id long, shingles binary").coalesce(wide))
    hubs = checkpointed(sets.where("id = pivot").select("grp", F.col("shingles").alias("hub")).coalesce(wide))
    told = checkpointed(sets.where("pivot is not null").join(hubs, "grp").mapInArrow(lean(_beside_pivot(least)), "grp long, pivot long, id long, shingles binary, alike boolean").coalesce(wide))
    pairs = told.where("alike").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    blocks = lambda where: F.greatest(F.lit(1), F.ceil(F.sum(F.when(where, F.octet_length("shingles"))) / BLOCK_BYTES)).cast("int")
    open_groups = told.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(~F.col("alike")).alias("n_odd"), blocks(~F.col("alike")).alias("odd_blocks"), blocks(F.col("alike")).alias("more_blocks"))
    open_groups = checkpointed(open_groups.where("n_odd > 0 and n > 2").select("grp", "odd_blocks", "more_blocks").coalesce(tasks))
    place = F.xxhash64("id")
    cut = told.join(open_groups, "grp").withColumn("block", F.when(F.col("alike"), F.col("odd_blocks") + F.pmod(place, F.col("more_blocks"))).otherwise(F.pmod(place, F.col("odd_blocks"))))
    others = F.filter(F.sequence(F.lit(0), F.col("odd_blocks") + F.col("more_blocks") - 1), lambda o: (o != F.col("block")) & ((F.col("block") < F.col("odd_blocks")) | (o < F.col("odd_blocks"))))
    dealt = cut.withColumn("other", F.explode(others)).select(F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "id", "shingles", "alike")
    late = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_links_of_blocks(least)), "a long, b long").coalesce(wide)
    side = lambda name, held: sets.join(loose, "id", "left_semi").select(F.col("id").alias(name), F.col("shingles").alias(held))
    across = apart.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(lean(_alike(least)), "a long, b long")
    roots = components(pairs.unionByName(late).unionByName(across))
    grouped = checkpointed(member.join(roots, member.id == roots.node, "left").select("name", "same", F.coalesce("root", "id").alias("root")).coalesce(tasks))
    chiefs = grouped.groupBy("root").agg(F.min(F.struct("name", "same")).alias("chief"))
    return checkpointed(grouped.join(chiefs, "root").select("name", "same", "chief").coalesce(tasks))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, component_id) of all rows with an id; component_id is the smallest id of the texts that ``similar_texts`` groups."""
    rows = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), _md5(docs[text_col]).alias("same"))
    return rows.join(similar_texts(docs, id_col, text_col, **options), "same").select("doc_id", F.col("chief.name").alias("component_id"))


def _md5(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of similar texts, that of the smallest id, with all its columns.

    Rows of one id and one text are one document; rows of one id with other texts are others. Rows without an id can't be told apart and stay.
    """
    chief = similar_texts(docs, id_col, text_col, **options).select(F.col("chief.name").alias("_name"), F.col("chief.same").alias("_same")).distinct()
    named = docs.where(docs[id_col].isNotNull()).withColumns({"_name": docs[id_col].cast("long"), "_same": _md5(docs[text_col])})
    kept = named.dropDuplicates(["_name", "_same"]).join(chief, ["_name", "_same"], "left_semi").select(docs.columns)
    return kept.unionByName(docs.where(docs[id_col].isNull()))
