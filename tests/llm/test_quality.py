from pyspark.sql import functions as F
import re
from collections import Counter

import numpy as np
from conftest_data import documents, table
from impactrank.llm import pu, rules
from impactrank.llm.common import crc_fold
from impactrank.llm.queries import op1_pu_quality, op3_quality_rules

SF = "/root/testdata/sf0.1"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(spark, sf_dir, odd, labels):
    rows = op3_quality_rules(spark, sf_dir).collect()
    texts = dict(documents(sf_dir))
    assert len(rows) == len(texts)
    for r in rows + rules.quality_rules(odd.where("doc_id <> 6 and doc_id is not null"), labels).collect():
        text = texts[r.doc_id] if r in rows else None
        if r in rows:
            want = brute_counts(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_counts_of_odd_rows(odd, labels):
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    rows = rules.quality_rules(odd, labels).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id])


def heldout(found, sf_dir):
    truth = {r["doc_id"]: r["quality"] for r in table(sf_dir, "labels")}
    own = [(truth[i], v) for i, v in found if i in truth and crc_fold(i, 3) == 1]
    return np.array([t for t, _ in own]), np.array([v for _, v in own])


def test_rules_on_held_out_labels(spark):
    truth, kept = heldout([(r.doc_id, r.probability >= 0.5) for r in op3_quality_rules(spark, SF).collect()], SF)
    assert (truth == kept).mean() > 0.97


def test_score_on_held_out_labels(spark):
    rows = op1_pu_quality(spark, SF).collect()
    assert all(r.held_out == (crc_fold(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    truth, score = heldout([(r.doc_id, r.score) for r in rows], SF)
    order = np.argsort(np.argsort(score))
    good = truth == 1
    area = (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.97 and ((score >= 0.5) == truth).mean() > 0.93


def test_odd_rows_and_no_labels(odd, labels):
    assert pu.quality_scores(odd, labels).count() == odd.count()
    assert {r.score for r in pu.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.kept for r in rules.quality_rules(odd, labels.limit(0)).where("not base_failed").collect()} <= {True}
    assert pu.quality_scores(odd.limit(0), labels).count() == rules.quality_rules(odd.limit(0), labels).count() == 0
    assert pu.accepted(odd, labels).columns == odd.columns == rules.passed(odd, labels).columns


def test_the_risk_is_held_at_zero():
    rng = np.random.default_rng(0)
    positive = np.hstack([rng.normal(1, 1, (300, 5)), np.ones((300, 1))]).astype(np.float32)
    negative = np.hstack([rng.normal(-1, 1, (300, 5)), np.ones((300, 1))]).astype(np.float32)
    free = np.vstack([positive[:150] + 0.01, negative[:150]])
    assert 0.3 < pu.estimate_prior(positive, free) < 0.6
    weights = pu.fit(positive, free, 0.5)
    assert (negative[150:] @ weights < 0).mean() > 0.95 and (positive @ weights > 0).mean() > 0.9


def test_a_repeated_id_is_sampled_once(spark):
    from impactrank.llm.pu import sample_features

    docs = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2).alias("text"))
    x, role = sample_features(docs, spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id long, role int"))
    assert len(x) == 2 and sorted(role) == [0, 1] and (x[0] == x[1]).all()


def test_driver_holds_the_sample_at_most_twice(spark):
    import tracemalloc

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = 0
    fit = pu.fit

    def watched(positive, free, *more):
        nonlocal held
        held = positive.nbytes + free.nbytes
        return fit(positive, free, *more)

    tracemalloc.start()
    try:
        pu.fit = watched
        pu.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        pu.fit = fit
        tracemalloc.stop()
    assert held > 40_000_000 and peak < 2.4 * held
