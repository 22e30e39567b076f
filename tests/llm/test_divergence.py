import re
from collections import Counter

import pytest
from conftest_data import table
from impactrank.llm import divergence as D
from pyspark.sql import functions as F

SCHEMA = "doc_id long, lang string, source string, text string, term string, n long, p long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, listed):
    """The audit from (lang, source, text) rows, term by term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    split = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in split}:
        docs = Counter(t for a, _, ts in split if a == lang for t in set(ts))
        kept = sorted(t for t, n in docs.items() if n >= least)
        sources = sorted({r[1] for r in split if r[0] == lang}, key=str.encode)
        count = {s: Counter(t for a, b, ts in split if (a, b) == (lang, s) for t in ts) for s in sources}
        share = lambda own: {t: 1 + 10**9 * (own[t] + 5) // (sum(own[u] for u in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(count[s]) for s in sources}
        q = share(sum(count.values(), Counter()))
        for s in sources:
            apart = {o: sum(abs(p[s][t] - p[o][t]) for t in kept) for o in sources if o != s}
            more = {t: p[s][t] - q[t] for t in kept if count[s][t] and p[s][t] > q[t]}
            for part, own, most in (("pair", apart, len(apart)), ("term", more, listed)):
                ranked = sorted(own.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)}
    return out


def found(frame):
    rows = frame.collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


ODD = [
    (1, None, None, None),
    (2, "en", None, "The THE the\x00the"),
    (3, "en", "", "tHe Ünï İstanbul 9a9 𝒳𝒳"),
    (4, "en", "b", "the cat`cat[cat"),
    (4, "en", "b", "the cat`cat[cat"),
    (5, "en", "é", ""),
    (6, "de", "only", "the the the"),
    (7, "xx", "s1", "lonely"),
    (8, "xx", "s2", None),
    (None, "en", "b", "ünï the " * 2000),
]


@pytest.mark.parametrize("held", [1, 200_000])
def test_odd_rows_equal_a_plain_count(spark, monkeypatch, held):
    """Also where a task sends its counts after each batch, and where hardly a term is listed."""
    for name, value in (("HELD", held), ("MIN_DOCUMENTS", 2), ("LISTED", 1)):
        monkeypatch.setattr(D, name, value)
    docs = spark.createDataFrame([(*r, None, None, None) for r in ODD], SCHEMA).repartition(3)
    assert found(D.source_divergence(docs)) == plain([r[1:] for r in ODD], 2, 1)


def test_arrays_joined_by_shuffle_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "MIN_DOCUMENTS", 1)
    docs = spark.createDataFrame([(*r, None, None, None) for r in ODD], SCHEMA)
    want = found(D.source_divergence(docs))
    monkeypatch.setattr(D, "BROADCAST_GROUPS", 0)
    assert found(D.source_divergence(docs)) == want == plain([r[1:] for r in ODD], 1, 50)


def test_empty_table(spark):
    assert D.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_documents_equal_a_plain_count(spark, sf_dir):
    rows = [(r["lang"], r["source"], r["text"]) for r in table(sf_dir, "documents")]
    assert found(D.source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == plain(rows, 30, 50)


def test_shares_of_huge_counts_are_exact(spark):
    one = spark.range(1).select(*(F.lit(v).cast("long").alias(c) for c, v in (("n", 10**17 + 3), ("total", 3 * 10**18), ("kept", 10**12))))
    got = one.select(D._share(F.col("n"), F.col("total"), F.col("kept"))).first()[0]
    assert got == 1 + 10**9 * (10**17 + 8) // (3 * 10**18 + 5 * 10**12)
