import random
import re

import numpy as np
import pytest
from impactrank.operators import index as I
from impactrank.operators import rank as R
from impactrank.operators.index import Index, bm25_postings, doc_list, postings, segments, vocabulary
from impactrank.operators.stats import summary
from pyspark.sql import functions as F


def index_of(spark, posts):
    frame = spark.createDataFrame(posts, "term string, docid long, impact int")
    docs = frame.select("docid").distinct().withColumn("docno", F.concat(F.lit("doc-"), "docid"))
    return Index(segments(frame), frame, docs)


def queries_of(spark, queries):
    rows = [(q, i, t) for q, terms in queries.items() for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "query_id long, term_pos int, term string")


def run_of(frame):
    return [(r.query_id, r.docid, r.rsv) for r in frame.orderBy("query_id", "rank").collect()]


#: Term a: {1: [1]}; term b: {2: [0], 1: [1]}.
TIE = [("a", 1, 1), ("b", 0, 2), ("b", 1, 1)]


def test_higher_docid_wins_ties(spark):
    assert run_of(R.rank(queries_of(spark, {1: ["a", "b"]}), index_of(spark, TIE), 1)) == [(1, 1, 2)]


def test_loose_stop_may_lose_a_tie(spark):
    terms, index = queries_of(spark, {1: ["a", "b"]}), index_of(spark, TIE)
    assert run_of(R.rank(terms, index, 1, mode="early", strict=True)) == [(1, 1, 2)]
    assert run_of(R.rank(terms, index, 1, mode="early", strict=False))[0][1] in (0, 1)


def test_repeated_terms_count_again(spark):
    index = index_of(spark, [("a", 5, 3), ("b", 6, 4)])
    assert run_of(R.rank(queries_of(spark, {1: ["a", "a", "b"]}), index)) == [(1, 5, 6), (1, 6, 4)]


def test_unknown_terms_give_nothing(spark):
    index = index_of(spark, [("a", 5, 3)])
    terms = queries_of(spark, {1: ["x"], 2: ["x", "a"]})
    assert run_of(R.rank(terms, index, 100)) == [(2, 5, 3)]
    assert R.unknown_terms(terms, vocabulary(index.heads)).count() == 2


def test_budget_is_a_prefix(spark):
    """A segment that does not fit ends the plan, though a later one would fit."""
    posts = [("a", d, 9) for d in range(3)] + [("b", d, 8) for d in range(10)] + [("c", 50, 7)]
    plan = R.segment_plan(queries_of(spark, {1: ["a", "b", "c"]}), index_of(spark, posts).heads)
    assert [r.term for r in R.within_budget(plan, 5).orderBy("seq").collect()] == ["a"]
    assert R.within_budget(plan, 13).count() == 2
    assert R.within_budget(plan, None).count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_modes_agree_with_brute_force(spark, seed):
    chance = random.Random(seed)
    posts = [(t, d, chance.randint(1, 5)) for t in "abcd" for d in chance.sample(range(12), 8)]
    queries = {q: [chance.choice("abcdz") for _ in range(3)] for q in range(6)}
    terms, index = queries_of(spark, queries), index_of(spark, posts)
    want = []
    for q, own in queries.items():
        score = {}
        for t in own:
            for t2, d, i in posts:
                if t == t2:
                    score[d] = score.get(d, 0) + i
        want += [(q, d, s) for s, d in sorted(((s, d) for d, s in score.items()), reverse=True)[:3]]
    full = run_of(R.rank(terms, index, 3))
    assert full == want
    assert run_of(R.rank(terms, index, 3, budget=10**9, mode="anytime")) == want
    assert [(q, d) for q, d, _ in run_of(R.rank(terms, index, 3, mode="early"))] == [(q, d) for q, d, _ in want]


def test_index_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a a b's"), (3, "a")], "doc_id long, text string")
    assert {(r.term, r.docid, r.impact) for r in postings(docs).collect()} == {("a", 3, 3), ("b", 3, 1), ("s", 3, 1)}
    assert doc_list(docs).count() == 4
    assert postings(docs.limit(0)).count() == 0


def test_bm25_impacts_are_in_range(spark, sf_dir):
    found = bm25_postings(spark.read.parquet(f"{sf_dir}/documents.parquet")).agg(F.min("impact"), F.max("impact")).first()
    assert tuple(found) == (1, 255)


def test_summary_of_no_queries(spark):
    none = spark.createDataFrame([], "query_id long, segments_processed long, postings_processed long")
    assert summary(none).first().asDict() == {"topics": 0, "total_segments": None, "total_postings": None, "mean_segments": None, "mean_postings": None}


def plain_early(posts, terms, k, strict):
    """One query walked segment by segment over all its documents."""
    segments = {}
    for t, d, i in posts:
        segments.setdefault((t, i), []).append(d)
    order = sorted(((-i, len(ds), p, t, i) for p, t in enumerate(terms) for (u, i), ds in segments.items() if u == t))
    top = {p: max((i for (u, i) in segments if u == t), default=0) for p, t in enumerate(terms)}
    left, score, postings, checks = dict(top), {}, 0, 0
    for n, (_, size, p, t, i) in enumerate(order, 1):
        for d in segments[t, i]:
            score[d] = score.get(d, 0) + i
        postings += size
        left[p] = max((j for (u, j) in segments if u == t and j < i), default=0)
        best = sorted(((s, d) for d, s in score.items()), reverse=True)[: k + 1]
        if len(best) > k:
            checks += 1
            least = min(a[0] - b[0] for a, b in zip(best, best[1:]))
            if least > sum(left.values()) or (not strict and least == sum(left.values())):
                return [(d, s, r, n, postings, checks, 1) for r, (s, d) in enumerate(best[:k], 1)]
    return [(d, s, r, len(order), postings, checks, 0) for r, (s, d) in enumerate(best[:k], 1)]


@pytest.mark.parametrize("first,bits", [(1, 20), (6, 3), (16_384, 20)])
def test_early_termination_equals_a_plain_walk(spark, monkeypatch, first, bits):
    """Also where rounds are small, so that queries are settled in different ones, and where a segment is many blocks."""
    monkeypatch.setattr(R, "FIRST_ROUND", first)
    monkeypatch.setattr(R, "GROWTH", 2)
    for module in (R, I):
        monkeypatch.setattr(module, "BODY_BITS", bits)
    chance = random.Random(11)
    posts = [(t, d, chance.choice([1, 2, 5, 40, 200])) for t in "abcde" for d in chance.sample(range(30), 20)] + [("f", 1, 255), ("g", 2, 90), ("f", 2, 3)]
    queries = {q: [chance.choice("abcdefg") for _ in range(chance.randint(1, 4))] for q in range(12)}
    for strict in (True, False):
        found = R.early(queries_of(spark, queries), index_of(spark, posts), 2, strict).collect()
        for q, terms in queries.items():
            got = sorted((r[1:8] for r in found if r.query_id == q), key=lambda r: r[2])
            assert list(map(tuple, got)) == plain_early(posts, terms, 2, strict)
    assert {r.stopped for r in found} == {0, 1}
    assert all(r.read >= r.postings for r in found) and (first > 1 or any(r.read < sum(1 for t in queries[r.query_id] for p in posts if p[0] == t) for r in found))


def test_early_termination_of_far_apart_ids_and_no_known_terms(spark):
    posts = [(t, (d * 2654435761 * 40503) % 2**62, i) for t, d, i in (("a", 1, 9), ("a", 2, 9), ("b", 2, 200), ("b", 3, 4), ("c", 4, 1), ("c", 1, 1))]
    index = index_of(spark, posts)
    found = R.early(queries_of(spark, {1: ["a", "b", "c"], 2: ["zz"], 3: ["c"]}), index, 2).collect()
    for q, terms in ((1, "abc"), (3, "c")):
        assert [tuple(r[1:8]) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == plain_early(posts, terms, 2, True)
    assert {r.query_id for r in found} == {1, 3} and R.early(queries_of(spark, {2: ["zz"]}), index, 2).count() == 0


def test_scores_far_apart_equal_those_close_together():
    chance = np.random.default_rng(3)
    near, far, plain = R._Scores(), R._Scores(), {}
    for _ in range(40):
        ids = np.unique(chance.integers(0, 500, 60))
        for d in ids.tolist():
            plain[d] = plain.get(d, 0) + 3
        a, b = near.add(ids, 3), far.add(ids * 10**12, 3)
        assert a.tolist() == b.tolist() == [plain[d] for d in ids.tolist()]
    assert far.ids is not None and near.ids is None
    assert dict(zip(*(x.tolist() for x in near.all()))) == plain == {d // 10**12: s for d, s in zip(*(x.tolist() for x in far.all()))}


def test_bodies_and_gaps_go_over_blocks(spark, monkeypatch):
    from impactrank.operators import gaps as G
    from impactrank.operators import index as I

    monkeypatch.setattr(I, "BODY_BITS", 3)
    monkeypatch.setattr(G, "BODY_BITS", 3)
    chance = random.Random(2)
    posts = sorted({(t, d, i) for t, i in (("a", 1), ("a", 2), ("b", 1)) for d in chance.sample(range(200), 37)})
    frame = spark.createDataFrame(posts, "term string, docid long, impact int")
    assert sum(len(r.docids) for r in I.segment_postings(frame).collect()) == len(posts) and I.segment_postings(frame).count() > 3
    with pytest.raises(ValueError):
        G.gaps(frame, 5)
    for stride in (1, 2, 4):
        blocks = G.block_gaps(I.with_heads(I.segment_postings(frame)), stride)
        assert sorted((r.term, r.docid, r.impact) for r in G.from_block_gaps(blocks.drop("docids"), stride).collect()) == posts
        coded = G.gaps(frame, stride)
        for r in coded.collect():
            own = [d for t, d, i in posts if (t, i) == (r.term, r.impact)]
            at = own.index(r.docid)
            assert (r.pos, r.gap) == (at, own[at] - (own[at - stride] if at >= stride else 0))
        assert sorted((r.term, r.docid, r.impact) for r in G.from_gaps(coded.drop("docid"), stride).collect()) == posts


@pytest.mark.parametrize("k", [1, 7, 60, 10**6])
def test_ranks_by_counts_equal_a_window(spark, monkeypatch, k):
    """Few distinct scores, so that ties go over blocks, and far-apart ones, so that they go over ranges."""
    chance = random.Random(k)
    rows = [(q, d, chance.choice([1, 2, 2, 2, 300, 900, 70_000])) for q in range(4) for d in chance.sample(range(400), 50 + 30 * q)]
    scores = spark.createDataFrame(rows, "query_id long, docid long, rsv long")
    want = sorted(map(tuple, R.top_k(scores, k).select("query_id", "docid", "rsv", "rank").collect())) if k <= R.WINDOW_RANKS else None
    monkeypatch.setattr(R, "WINDOW_RANKS", 0)
    monkeypatch.setattr(R, "BODY_BITS", 4)
    got = R.top_k(scores, k)
    found = sorted(map(tuple, got.collect()))
    plain = []
    for q in range(4):
        own = sorted(((s, d) for p, d, s in rows if p == q), reverse=True)[:k]
        plain += [(q, d, s, i) for i, (s, d) in enumerate(own, 1)]
    assert found == sorted(plain) and want in (None, found)
    keys = re.findall(r"windowspecdefinition\((\w+)#\d+L?, (\w+)", got._jdf.queryExecution().analyzed().toString())
    assert keys and all(first == "query_id" and second in ("rsv", "range") for first, second in keys)


def test_far_apart_ids_fill_blocks_as_close_ones_do(spark, monkeypatch, tmp_path):
    """The stored index has the same rows, heads and ranks, whatever numbers the documents have."""
    from impactrank.sources import indexio

    for module in (R, I):
        monkeypatch.setattr(module, "BODY_BITS", 3)
    monkeypatch.setattr(R, "WINDOW_RANKS", 0)
    chance = random.Random(8)
    far = sorted(chance.sample(range(2**62), 100))
    posts = [(t, d, chance.choice([1, 1, 2])) for t in "ab" for d in sorted(chance.sample(range(100), 70))]
    shapes, runs = [], []
    for name, number in (("close", list(range(100))), ("far", far)):
        frame = spark.createDataFrame([(t, number[d], i) for t, d, i in posts], "term string, docid long, impact int")
        docs = spark.createDataFrame([(d, f"doc-{d}") for d in number], "docid long, docno string")
        assert I.block_cuts(docs) == number[8::8]
        indexio.write_index(Index(segments(frame), frame, docs), str(tmp_path / name), 2)
        index = indexio.read_index(spark, str(tmp_path / name))
        back = {d: i for i, d in enumerate(number)}
        bodies = index.bodies.collect()
        shapes.append(sorted((r.term, r.impact, r.block, r.freq, r.pos, [back[d] for d in r.before], [back[d] for d in r.docids]) for r in bodies))
        runs.append(sorted((r.query_id, r["rank"], back[r.docid], r.rsv) for r in R.rank(queries_of(spark, {1: ["a", "b", "a"]}), index, 50).collect()))
    assert shapes[0] == shapes[1] and runs[0] == runs[1] and len(runs[0]) == 50
    assert max(r[3] for r in shapes[0]) > 4 and any(r[6][0] > 8 and len(r[5]) == 4 for r in shapes[0])
    assert indexio.read_index(spark, str(tmp_path / "close")).cuts == list(range(8, 100, 8))


def test_gaps_and_back_take_one_exchange(spark, sf_dir):
    from impactrank.plans.queries import QUERIES

    plan = QUERIES["gaps_d4_roundtrip"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("FileScan") == 1


@pytest.mark.parametrize("accuracy", [100, 10**6])
def test_quantile_impacts_are_those_of_exact_ranks_within_the_bound(spark, accuracy):
    """Skewed weights with many ties; an impact says how many cuts lie below, and a cut's rank is off by n / accuracy at most."""
    chance = random.Random(accuracy)
    weights = [round(chance.choice([chance.expovariate(1), 0.25, 7.5]), 6) for _ in range(5000)]
    frame = spark.createDataFrame([("t", d, w) for d, w in enumerate(weights)], "term string, docid long, weight double").repartition(5)
    got = {r.docid: r.impact for r in I.quantile_impacts(frame, 20, accuracy).collect()}
    assert len(got) == 5000 and set(got.values()) <= set(range(1, 21))
    ordered = np.sort(weights)
    slack = 5000 / accuracy + 1
    for d, w in enumerate(weights):
        below, upto = np.searchsorted(ordered, w, "left"), np.searchsorted(ordered, w, "right")
        least, most = (sum(np.ceil(5000 * i / 20) + s <= n for i in range(1, 20)) for n, s in ((below, slack), (below, -slack)))
        assert least <= got[d] - 1 <= most and upto > below
    by_weight = sorted((w, got[d]) for d, w in enumerate(weights))
    assert all(a[1] <= b[1] and (a[0] < b[0] or a[1] == b[1]) for a, b in zip(by_weight, by_weight[1:]))
    assert I.quantile_impacts(frame.limit(0), 20).count() == 0
