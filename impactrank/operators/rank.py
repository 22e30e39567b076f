"""Score-at-a-time ranking of all queries at once.

A query is a bag of terms with positions: ``qterms(query_id, term_pos, term)``. Its segments are taken by falling
impact, then rising size, then position. Exhaustive ranking takes all of them, anytime ranking a prefix within a
budget of postings that is decided from headers alone, and early termination stops when the ranking can no longer change.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from impactrank.shared import written

from .index import BODY_BITS, Index, block_of
from .scoring import DEALT, SENT_SEGMENTS, TOGETHER, cells, dealt, parts_of, scores

#: Postings of a query that the first round of early termination reads at least (two megabytes, less work than starting a round), and by how much a round reads more than the one before.
FIRST_ROUND, GROWTH = 1 << 18, 8
#: Ranks that Spark cuts within tasks before it sorts a query's rows in one; beyond, ranks come from counts.
WINDOW_RANKS = 1000
#: Neighbouring scores that count as one range where ranks come from counts, as a power of two.
RANGE_BITS = 8


def term_lookup(qterms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Query terms with their vocabulary rows; unknown terms drop out, repeated ones stay."""
    return qterms.join(vocab, "term").select("query_id", "term_pos", "term", "df", "n_segments", "max_impact")


def unknown_terms(qterms: DataFrame, vocab: DataFrame) -> DataFrame:
    return qterms.join(vocab, "term", "left_anti").select("query_id", "term_pos", "term")


def segment_plan(qterms: DataFrame, heads: DataFrame) -> DataFrame:
    """(query_id, term_pos, term, impact, freq, seq, cum_freq): a query's segments in order, numbered from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("impact"), "freq", "term_pos")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = qterms.join(heads, "term")
    return joined.select("query_id", "term_pos", "term", "impact", "freq", F.row_number().over(order).alias("seq"), F.sum("freq").over(running).alias("cum_freq"))


def with_bounds(plan: DataFrame) -> DataFrame:
    """The plan with next_impact of the term and remaining: what any document can still gain after the segment."""
    own = Window.partitionBy("query_id", "term_pos").orderBy(F.desc("impact"))
    follow = F.coalesce(F.lead("impact").over(own), F.lit(0))
    first = F.when(F.row_number().over(own) == 1, F.col("impact")).otherwise(0)
    marked = plan.withColumns({"next_impact": follow, "_first": first})
    upto = Window.partitionBy("query_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum("_first").over(Window.partitionBy("query_id"))
    return marked.withColumn("remaining", start + F.sum(F.col("next_impact") - F.col("impact")).over(upto)).drop("_first")


def within_budget(plan: DataFrame, budget: int | None) -> DataFrame:
    """The prefix of a plan that a budget of postings allows; a segment that does not fit ends it."""
    return plan if budget is None else plan.where(F.col("cum_freq") <= budget)


def accumulate(plan: DataFrame, index: Index, k: int | None = None) -> DataFrame:
    """(query_id, docid, rsv): the sum of impacts over the chosen segments, each occurrence of a term counted; with ``k`` at least the k best of each query.

    Equal (query, term, impact) segments are first counted, so a repeated term is joined once.
    """
    return scores(_times(plan), index, k)


def _times(plan: DataFrame) -> DataFrame:
    return plan.groupBy("query_id", "term", "impact").agg(F.count("*").alias("times"), F.max("freq").alias("freq"))


def top_k(scores: DataFrame, k: int, cuts: list[int] | None = None) -> DataFrame:
    """(query_id, docid, rsv, rank): by falling score, then falling docid. Ranks to a few hundred are a window that tasks cut before they send rows on; more come from counts, by the blocks that ``cuts`` bound."""
    if k > WINDOW_RANKS:
        return _ranks_by_counts(scores.select("query_id", "rsv", block_of(F.col("docid"), cuts).alias("block"), F.array("docid").alias("docids")), k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rsv"), F.desc("docid")))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def _ranks_by_counts(hits: DataFrame, k: int, tasks: int | None = None) -> DataFrame:
    """The same rows of (query_id, rsv, block, docids), where a query may have more of them than one task can sort.

    Hits are counted by cell, a score and a block of docids. A row's rank is the number of rows in better cells and its place in its own, which
    holds at most the documents of a block. Sums over cells go in steps: blocks of a score, scores of a range, ranges of a query (an array).
    Cells meet as arrays, in ``tasks`` tasks if given; rows of a hit are made last of all and not sorted.
    """
    keys = ["query_id", "rsv", "block"]
    hits = hits.where(" AND ".join(f"{c} IS NOT NULL" for c in keys))  # as the joins ask of it; said here, one exchange serves both uses
    met = hits if tasks is None else hits.repartition(tasks, *keys)
    own = met.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("docids")), asc=False).alias("docids"))
    cells = met.groupBy(*keys).agg(F.sum(F.size("docids")).alias("n"))
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = cells.withColumn("in_score", before(["query_id", "rsv"], "block"))
    by_score = cells.groupBy("query_id", "rsv").agg(F.sum("n").alias("n")).withColumn("range", F.shiftright("rsv", RANGE_BITS))
    by_score = by_score.withColumn("in_range", before(["query_id", "range"], "rsv"))
    ranges = by_score.groupBy("query_id", "range").agg(F.sum("n").alias("n"))
    whole = ranges.groupBy("query_id").agg(F.collect_list(F.struct("range", "n")).alias("ranges"))
    better = F.aggregate(F.filter("ranges", lambda r: r["range"] > F.col("range")), F.lit(0).cast("long"), lambda total, r: total + r["n"])
    placed = by_score.drop("n").join(whole, "query_id").select("query_id", "rsv", (F.col("in_range") + better).alias("above")).where(F.col("above") < k)
    offsets = blocks.join(placed, ["query_id", "rsv"]).select(*keys, (F.col("above") + F.col("in_score")).alias("offset")).where(F.col("offset") < k)
    ranked = own.join(offsets, keys).select("query_id", "rsv", "offset", F.posexplode("docids").alias("place", "docid"))
    return ranked.select("query_id", "docid", "rsv", (F.col("offset") + F.col("place") + 1).cast("int").alias("rank")).where(F.col("rank") <= k)


def named(run: DataFrame, docs: DataFrame) -> DataFrame:
    """A run with document names, joined after the cut to k."""
    return run.join(docs, "docid").select("query_id", "docid", "docno", "rank", "rsv")


def rank(qterms: DataFrame, index: Index, k: int = 10, budget: int | None = None, mode: Literal["exhaustive", "anytime", "early"] = "exhaustive", strict: bool = True, watch: Observation | None = None) -> DataFrame:
    """The run of all queries. ``budget`` counts postings and holds in anytime mode; ``strict`` in early mode. ``watch`` gets topics, segments, postings, checks and stops as the run is made."""
    if mode == "early":
        run = early(qterms, index, k, strict)
        first = F.when(F.col("rank") == 1, 1)
        if watch is not None:
            run = run.observe(watch, F.count(first).alias("topics"), *(F.sum(first * F.col(c)).alias(name) for c, name in (("segments", "segments"), ("postings", "postings"), ("checks", "checks"), ("stopped", "stops"))))
        return run.select("query_id", "docid", "rsv", "rank")
    plan = within_budget(segment_plan(qterms, index.heads), budget if mode == "anytime" else None)
    if watch is not None:
        plan = plan.observe(watch, F.count(F.when(F.col("seq") == 1, 1)).alias("topics"), F.count("*").alias("segments"), F.sum("freq").alias("postings"), F.sum(F.lit(0)).alias("checks"), F.sum(F.lit(0)).alias("stops"))
    if k > WINDOW_RANKS:
        hits, tasks = cells(_times(plan), index, k)
        return _ranks_by_counts(hits, k, tasks)
    return top_k(accumulate(plan, index, k), k, index.cuts)


def score_gaps(run: DataFrame) -> DataFrame:
    """A run with the gap to the next score; null for the last."""
    return run.withColumn("gap", F.col("rsv") - F.lead("rsv").over(Window.partitionBy("query_id").orderBy("rank")))


def overlap(run: DataFrame, reference: DataFrame) -> DataFrame:
    """(query_id, n_reference, n_shared): how much of a reference run another one finds."""
    hit = run.select("query_id", "docid", F.lit(1).alias("hit"))
    return reference.join(hit, ["query_id", "docid"], "left").groupBy("query_id").agg(F.count("*").alias("n_reference"), F.count("hit").alias("n_shared"))


def early(qterms: DataFrame, index: Index, k: int = 10, strict: bool = True) -> DataFrame:
    """(query_id, docid, rsv, rank, segments, postings, checks, stopped, read) with the scores so far where a query stopped; read counts the postings looked at for it.

    After each segment the k + 1 best so far are looked at; the query stops when no gap between
    neighbours could still close: every gap over what remains (strict), or at least it (not strict, where ties may come out otherwise).

    Queries go in rounds. A round reads the segments that begin within a number of postings that grows by ``GROWTH``, and at least as far
    as the next step at which the query may stop, told from headers. It reads them from the first, as rounds grow so fast that the earlier ones cost less than
    their scores would cost to keep. A part of a block gets a body once for many queries and tells which of its own k + 1 best change at a step; only these changes meet in one task for a query.
    """
    plan = written(with_bounds(segment_plan(qterms, index.heads)))
    none = F.lit(0).cast("long")
    open_ = plan.groupBy("query_id").agg(F.lit(0).alias("at"), none.alias("least"), none.alias("span"), F.lit(0).alias("filled"))
    best: DataFrame | None = None
    found: list[DataFrame] = []
    budget = FIRST_ROUND
    while True:
        goals = written(_goals(plan, open_, k, strict, budget))
        if goals.isEmpty():
            return _all(found) if found else _nothing(plan)
        merged = written(_merged(plan, goals, _changes(plan, index, goals, k), best, k, strict))
        found.append(merged.where("settled AND rank <= " + str(k)).select(*_EARLY))
        best = merged.where("NOT settled")
        open_ = best.where("rank = 1").select("query_id", F.col("segments").alias("at"), "least", "span", "filled")
        budget *= GROWTH


_EARLY = ["query_id", "docid", "rsv", "rank", "segments", "postings", "checks", "stopped", "read"]
_MERGED = "query_id long, docid long, rsv long, rank int, segments int, postings long, checks int, stopped int, read long, settled boolean, least long, span long, filled int"
_CHANGED = "query_id long, seq int, docids array<long>, scores array<long>"


_TYPES = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in _MERGED.split(", ")]


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _nothing(plan: DataFrame) -> DataFrame:
    """No rows: no query knows a term."""
    return plan.sparkSession.createDataFrame([], _MERGED).select(*_EARLY)


def _goals(plan: DataFrame, open_: DataFrame, k: int, strict: bool, budget: int) -> DataFrame:
    """(query_id, at, to, left, last, filled): how far each open query reads in this round.

    A query can't stop where a gap can't have grown over what remains. A score grows by at most the next impact of every term that comes up, and the
    scores below don't fall: so no gap grows by more, nor do the k gaps together. Steps that even such gaps rule out are read in the same round.
    """
    ahead = plan.join(open_, "query_id").where(F.col("seq") > F.col("at"))
    fresh = F.row_number().over(Window.partitionBy("query_id", "term_pos").orderBy("seq")) == 1
    upto = Window.partitionBy("query_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = ahead.withColumn("fresh", F.when(fresh, F.col("impact")).otherwise(0)).withColumn("gain", F.sum("fresh").over(upto))
    one, every = F.col("least") + F.col("gain"), F.col("span") + F.col("gain")
    may = (F.col("remaining") < one) & (F.col("remaining") * k < every) if strict else (F.col("remaining") <= one) & (F.col("remaining") * k <= every)
    step = F.struct("seq", "remaining")
    within = F.max(F.when(F.col("cum_freq") - F.col("freq") < budget, step))
    goal = grown.groupBy("query_id", "at", "filled").agg(F.greatest(within, F.coalesce(F.min(F.when(may, step)), F.max(step))).alias("goal"), F.max("seq").alias("last"))
    return goal.select("query_id", "at", F.col("goal.seq").alias("to"), F.col("goal.remaining").alias("left"), "last", "filled")


def _changes(plan: DataFrame, index: Index, goals: DataFrame, k: int) -> DataFrame:
    """(query_id, seq, docids, scores): changes among the best of each query in a part of a block, by step.

    All queries take segments by falling impact, then rising size, so bodies stream past the scores of many queries in one order; only bodies equal in both are put in each query's own.
    """
    part = plan.join(goals.select("query_id", "to"), "query_id").where(F.col("seq") <= F.col("to"))
    n, queries = part.agg(F.count("*"), F.count_distinct("query_id")).first()
    parts = parts_of(index)
    places = parts * (1 + len(index.cuts or []))
    # where documents are few, queries are dealt to all cores
    groups = max(math.ceil(queries / TOGETHER), min(queries, math.ceil(plan.sparkSession.sparkContext.defaultParallelism / places)))
    many = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    wanted = part.withColumn("many", many).groupBy("term", "impact", "freq", "many").agg(F.collect_list(F.struct("query_id", F.col("seq").cast("long").alias("seq"))).alias("q"))
    wanted = F.broadcast(wanted) if n <= SENT_SEGMENTS else wanted
    met = index.arrays().select("term", "impact", "block", "docids").join(wanted, ["term", "impact"])
    met = met.select("many", "block", F.lit(0).alias("part"), F.col("q.query_id").alias("queries"), F.col("q.seq").alias("gains"), "docids", "impact", "freq")
    rows = met.mapInArrow(dealt(parts, ("impact", "freq")), f"{DEALT}, impact int, freq long") if parts > 1 else met
    tasks = min(1 << 11, 2 * groups * places)
    ordered = rows.repartition(tasks, "many", "block", "part").sortWithinPartitions("many", "block", "part", F.desc("impact"), "freq")
    return ordered.mapInArrow(_part_changes(k, parts), _CHANGED).join(goals.select("query_id", "at"), "query_id").where(F.col("seq") > F.col("at")).drop("at")


class _Scores:
    """Scores of the documents of one block: by place where ids lie close together, else by a sorted list of ids."""

    def __init__(self, bits: int | None = None) -> None:
        self.bits = BODY_BITS if bits is None else bits
        self.base: int | None = None
        self.ids: np.ndarray | None = None

    def add(self, docids: np.ndarray, gain: np.ndarray | int) -> np.ndarray:
        """The scores of ``docids``, which differ and rise, after ``gain``."""
        if self.base is None:
            self.base, self.held = int(docids[0]) >> self.bits << self.bits, np.zeros(1 << self.bits, np.int64)
        if self.ids is None and (docids[0] < self.base or docids[-1] - self.base >= 1 << self.bits):
            self.ids, self.held = self.all()
        if self.ids is None:
            at = docids - self.base
        else:
            at = np.searchsorted(self.ids, docids)
            new = (at == len(self.ids)) | (self.ids[np.minimum(at, len(self.ids) - 1)] != docids) if len(self.ids) else np.ones(len(docids), bool)
            if new.any():
                self.held = np.insert(self.held, at[new], 0)
                self.ids = np.insert(self.ids, at[new], docids[new])
                at = np.searchsorted(self.ids, docids)
        self.held[at] += gain
        return self.held[at]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.ids is not None:
            return self.ids, self.held
        at = np.flatnonzero(self.held)
        return at + self.base, self.held[at]


class _Best:
    """The scores of a query in a part, and the k + 1 best."""

    def __init__(self, k: int, bits: int) -> None:
        self.k, self.scores, self.best = k, _Scores(bits), []  # best: (score, place), falling

    def step(self, places: np.ndarray, impact: int) -> list[tuple[int, int]]:
        """The (score, place) among the best that a body changes."""
        here, after = places, self.scores.add(places, impact)
        if len(self.best) > self.k:
            near = np.flatnonzero(after >= self.best[-1][0])
            if not len(near):
                return []
            here, after = here[near], after[near]
        if len(here) > self.k + 1:
            order = np.lexsort((-here, -after))[: self.k + 1]
            here, after = here[order], after[order]
        new = dict(zip(here.tolist(), after.tolist()))
        at = np.searchsorted(places, [d for _, d in self.best])
        stay = [b for b, n in zip(self.best, at.tolist()) if n == len(places) or places[n] != b[1]]
        self.best = sorted([*stay, *((s, d) for d, s in new.items())], reverse=True)[: self.k + 1]
        return [b for b in self.best if b[1] in new]


def _part_changes(k: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Within a part docids leave the same remainder, so a place is the docid divided by the number of parts."""
    bits = max(1, BODY_BITS - (parts - 1).bit_length() + (1 if parts & (parts - 1) else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, list[int], list[int]]] = []
        key: tuple[int, int, int] | None = None
        level: tuple[int, int] | None = None
        held: dict[int, _Best] = {}
        equal: list[tuple[int, int, np.ndarray]] = []  # (seq, query, places) of bodies of one impact and size

        def taken() -> None:
            equal.sort(key=lambda e: e[0])
            for seq, query, places in equal:
                if query not in held:
                    held[query] = _Best(k, bits)
                changed = held[query].step(places, level[0])
                if changed:
                    out.append((query, seq, [d * parts + key[2] for _, d in changed], [s for s, _ in changed]))
            equal.clear()

        def sent() -> pa.RecordBatch:
            query, seq, ids, scores = zip(*out) if out else ((),) * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(seq, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (ids, scores))], names=["query_id", "seq", "docids", "scores"])

        for batch in batches:
            ends, flat = np.asarray(batch["docids"].offsets), np.asarray(batch["docids"].values, np.int64) // parts
            for i, (many, block, part, queries, seqs, impact, freq) in enumerate(zip(*(batch[c].to_pylist() for c in ("many", "block", "part", "queries", "gains", "impact", "freq")))):
                if (many, block, part) != key or (impact, freq) != level:
                    taken()
                    if (many, block, part) != key:
                        key, held = (many, block, part), {}
                    level = (impact, freq)
                places = flat[ends[i] : ends[i + 1]]
                if len(places):
                    equal += [(seq, query, places) for query, seq in zip(queries, seqs)]
            if len(out) >= 1 << 12:
                yield sent()
        taken()
        yield sent()

    return run


def _merged(plan: DataFrame, goals: DataFrame, changes: DataFrame, best: DataFrame | None, k: int, strict: bool) -> DataFrame:
    """The k + 1 best of each query where it stops, or at its goal, with what the next round needs to know."""
    part = plan.join(goals, "query_id").where((F.col("seq") > F.col("at")) & (F.col("seq") <= F.col("to")))
    listed = lambda *columns: F.array_sort(F.collect_list(F.struct(*columns)))
    steps = part.groupBy("query_id", "filled", (F.col("to") == F.col("last")).alias("ends")).agg(listed("seq", "remaining", "cum_freq").alias("steps"))
    rows = changes.select("query_id", "seq", F.explode(F.arrays_zip("docids", "scores")).alias("x")).select("query_id", "seq", F.col("x.docids").alias("docid"), F.col("x.scores").alias("score"))
    if best is not None:
        rows = rows.unionByName(best.select("query_id", F.col("segments").alias("seq"), "docid", F.col("rsv").alias("score")))
    events = rows.groupBy("query_id").agg(listed("seq", "docid", "score").alias("events"))
    return steps.join(events, "query_id").mapInArrow(_stops(k, strict), _MERGED)


def _stops(k: int, strict: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks the changes of each query's best documents; between two changes what remains only falls, so the step that ends the query is found by search."""
    names = [c.split()[0] for c in _MERGED.split(", ")]

    def one(query: int, filled: int, ends: bool, steps: pa.StructArray, events: pa.StructArray) -> list[tuple]:
        seqs, left, read = (np.asarray(steps.field(c)) for c in ("seq", "remaining", "cum_freq"))
        at, ids, scores = (np.asarray(events.field(c)) for c in ("seq", "docid", "score"))
        cuts = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
        first = np.searchsorted(seqs, at[cuts]).tolist()
        best: dict[int, int] = {}
        top: list[tuple[int, int]] = []
        stop = None
        for n, begin in enumerate(cuts.tolist()):
            end = int(cuts[n + 1]) if n + 1 < len(cuts) else len(at)
            best.update(zip(ids[begin:end].tolist(), scores[begin:end].tolist()))
            top = sorted(((s, d) for d, s in best.items()), reverse=True)[: k + 1]
            best = {d: s for s, d in top}
            if len(top) <= k:
                continue
            filled = filled or int(at[begin])
            least = min(a[0] - b[0] for a, b in zip(top, top[1:]))
            to = first[n + 1] if n + 1 < len(cuts) else len(seqs)
            low = left[to - 1] if to > first[n] else None
            if low is None or (low >= least if strict else low > least):
                continue
            stop = first[n] + int(np.flatnonzero(left[first[n] : to] < least if strict else left[first[n] : to] <= least)[0])
            break
        i = len(seqs) - 1 if stop is None else stop
        gaps = [a[0] - b[0] for a, b in zip(top, top[1:])] + ([top[-1][0]] if len(top) == k else [0] if len(top) < k else [])
        span = top[0][0] - (top[k][0] if len(top) > k else 0)
        checks = int(seqs[i]) - filled + 1 if filled else 0
        tail = (int(seqs[i]), int(read[i]), checks, int(stop is not None), int(read[-1]), stop is not None or ends, min(gaps), span, filled)
        return [(query, d, s, n, *tail) for n, (s, d) in enumerate(top, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for i in range(len(batch)) for r in one(batch["query_id"][i].as_py(), batch["filled"][i].as_py(), batch["ends"][i].as_py(), batch["steps"][i].values, batch["events"][i].values)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _TYPES)], names=names)

    return run
