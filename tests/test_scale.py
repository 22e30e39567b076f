"""What keeps work in step with the input: arrays instead of rows of postings and hits, bounded memory, rows dealt to all cores."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from impactrank.functions import codecs
from impactrank.operators import index as I
from impactrank.operators import rank as R
from impactrank.operators import scoring
from impactrank.plans.queries import QUERIES, index_path
from pyspark.sql import functions as F


def test_bodies_of_documents_are_those_of_their_postings(spark):
    """Also with ids that come twice or are null, null and empty texts, and blocks cut anywhere."""
    chance = random.Random(3)
    rows = [(chance.choice([None, *range(-40, 60), 2**62]), chance.choice([None, "", "a A b 12 12", " ".join(chance.choice("abcde") for _ in range(9))])) for _ in range(300)] + [(1000 + i, "a b a c") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cuts = [-5, 20, 1100]
    want = sorted(map(tuple, I.segment_postings(I.postings(docs.where("doc_id IS NOT NULL")), cuts).collect()))
    assert sorted(map(tuple, I.document_bodies(docs, cuts).collect())) == want and any(len(r[3]) > 20 for r in want)


def test_documents_become_bodies_in_one_exchange_of_arrays(spark, sf_dir):
    plan = I.Index.whole(spark.read.parquet(f"{sf_dir}/documents.parquet")).arrays()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate" not in plan


@pytest.mark.parametrize("quantiles", [False, True])
def test_weighted_bodies_are_those_of_weighted_postings(spark, quantiles):
    chance = random.Random(4)
    rows = [(chance.choice([None, *range(60)]), chance.choice([None, "", " ".join(chance.choice(["s", "es", *"abcdef"]) for _ in range(chance.randint(1, 30)))])) for _ in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    posts = I.bm25_postings(docs, quantiles=quantiles)
    want = sorted(map(tuple, I.segment_postings(posts.where("docid IS NOT NULL"), [30]).collect()))
    got = I.weighted_bodies(docs, [30], quantiles)
    assert len(want) > 50 and (quantiles or sorted(map(tuple, got.collect())) == want)
    assert sorted((r.term, d) for r in got.collect() for d in r.docids) == sorted((t, d) for t, _, _, ds in want for d in ds)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.split("HashAggregate")[0] and not any("docid#" in line for line in plan.split("\n") if "Exchange" in line)


@pytest.mark.parametrize("far", [False, True])
def test_scores_of_parts_are_plain_sums(spark, monkeypatch, far):
    for name, value in (("PART_BITS", 3), ("TOGETHER", 2), ("PAIRS", 20), ("WAITING", 30), ("ALONE", 6)):
        monkeypatch.setattr(scoring, name, value)
    chance = random.Random(5)
    ids = sorted(chance.sample(range(-(2**61), 2**62), 90)) if far else list(range(90))
    posts = [(t, d, chance.randint(1, 3)) for t in "abcd" for d in chance.sample(ids, chance.randint(1, 80))]
    frame = spark.createDataFrame(posts, "term string, docid long, impact int")
    index = I.Index(I.segments(frame), frame, spark.createDataFrame([(d, "x") for d in ids], "docid long, docno string"))
    queries = {q: [chance.choice("abcdz") for _ in range(4)] for q in range(9)} | {None: ["a", "b"]}
    terms = spark.createDataFrame([(q, i, t) for q, ts in queries.items() for i, t in enumerate(ts)], "query_id long, term_pos int, term string")
    sums = Counter()
    for q, ts in queries.items():
        for t, d, impact in posts:
            if (n := ts.count(t)) and q is not None:
                sums[q, d] += impact * n
    for k in (None, 4):
        got = R.accumulate(R.segment_plan(terms, index.heads), index, k)
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
        found = {(r.query_id, r.docid): r.rsv for r in got.where("query_id IS NOT NULL").collect()}
        assert found.items() <= sums.items() and (k or len(found) == len(sums)) and got.where("query_id IS NULL").count() > 0
        for q in range(9):
            best = sorted(((s, d) for (p, d), s in sums.items() if p == q), reverse=True)[: k or 10**6]
            assert all(found[q, d] == s for s, d in best)


def test_sql_ranking_reads_bodies_without_shuffling_them(spark, sf_dir):
    plan = QUERIES["rank_in_sql"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any("docids" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line) and "SortMergeJoin [term" not in plan


@pytest.mark.parametrize("codec", ["blocks_d0", "blocks_d4", "simple8b", "vbyte"])
def test_coding_holds_little_beside_its_batch(codec):
    """Codes of wide docids; all bits of a batch at once took 64 numbers for each."""
    values = np.cumsum(np.random.default_rng(2).integers(1, 1 << 14, codecs.AT_ONCE))
    encode, decode = codecs.CODECS[codec]
    tracemalloc.start()
    back = decode(encode([values]))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (back == values).all() and peak < 30 * values.nbytes
    assert list(codecs._portions(np.array([codecs.AT_ONCE + 1, 3, 4, codecs.AT_ONCE - 6, 1]))) == [(0, 1), (1, 3), (3, 5)]


def test_roots_are_found_on_all_cores(spark, sf_dir):
    assert QUERIES["math_reals"](spark, sf_dir).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_early_rounds_keep_no_scores_and_send_a_body_once_for_many_queries(spark, monkeypatch):
    """Scores of every query and document are neither written nor shuffled between rounds, and a body goes to queries in groups."""
    documents = spark.createDataFrame([(i, "a " * (1 + i % 5) + "b c" * (i % 3)) for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, p, t) for q in range(40) for p, t in enumerate("abc")], "query_id long, term_pos int, term string")
    tables, plans, real = [], [], R.written
    changes = R._merged
    monkeypatch.setattr(R, "written", lambda df, *name: tables.append(df.columns) or real(df, *name))
    monkeypatch.setattr(R, "_merged", lambda plan, goals, rows, *more: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or changes(plan, goals, rows, *more))
    monkeypatch.setattr(R, "FIRST_ROUND", 1)
    found = R.early(queries, I.Index.over(documents), 3)
    assert found.select("query_id").distinct().count() == 40
    assert tables and not any("scores" in columns for columns in tables)
    assert len(plans) > 1 and all("collect_list(struct(query_id" in p for p in plans)


def test_a_vocabulary_of_stems_is_made_of_arrays(spark, monkeypatch, tmp_path):
    """As counted row by row, also where forms of a stem share a document, ids come twice or are null, and blocks are several; no row of a posting is shuffled."""
    texts = ["running runs run", "runner running ran", None, "", "relational relate relates 7 7", "hopping hopes hope"]
    rows = [(i, texts[i % 6]) for i in range(40)] + [(3, "runs runs"), (None, "runs hopes"), (None, "hope")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(I, "BODY_BITS", 3)
    tf = I.term_frequencies(documents, stemmer="p")
    plain = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    found = I.stem_vocabulary(documents)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.schema.simpleString() == plain.schema.simpleString()
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["vocab_suffixes"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(docids" in plan


def test_all_hits_of_a_query_are_ranked_as_arrays_in_tasks_that_grow_with_them(spark, monkeypatch):
    """No row of a hit is sorted or shuffled, and twice the hits meet in twice the tasks; ties go over parts and blocks."""
    for module, name, value in ((I, "BODY_BITS", 5), (R, "BODY_BITS", 5), (scoring, "BODY_BITS", 5), (scoring, "PART_BITS", 4), (scoring, "HITS", 10)):
        monkeypatch.setattr(module, name, value)
    chance = random.Random(9)
    dealt = []
    for n in (80, 160):
        posts = [(t, d, chance.choice([1, 1, 2])) for t in "ab" for d in sorted(chance.sample(range(n), n // 2))]
        frame = spark.createDataFrame(posts, "term string, docid long, impact int")
        index = I.Index(I.segments(frame), frame, spark.createDataFrame([(d, "x") for d in range(n)], "docid long, docno string"), cuts=list(range(32, n, 32)))
        queries = {1: "ab", 2: "aab", 3: "z", 4: "b"}
        terms = spark.createDataFrame([(q, i, t) for q, ts in queries.items() for i, t in enumerate(ts)], "query_id long, term_pos int, term string")
        found = R.rank(terms, index, 10**6)
        want = []
        for q, ts in queries.items():
            sums = Counter()
            for t, d, impact in posts:
                sums[d] += impact * ts.count(t)
            want += [(q, d, s, i) for i, (s, d) in enumerate(sorted(((s, d) for d, s in sums.items() if s), reverse=True), 1)]
        assert sorted(map(tuple, found.collect())) == sorted(want)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "docid#" not in "".join(line for line in plan.split("\n") if "Sort " in line or "windowspec" in line)
        dealt.append({int(line.split("], ")[1].split()[0]) for line in plan.split("\n") if "RepartitionByExpression [query_id" in line})
    assert all(len(tasks) == 1 for tasks in dealt) and dealt[1].pop() == 2 * dealt[0].pop() > 2
