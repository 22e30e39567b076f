import random

import pytest
from impactrank.operators import rank as R
from impactrank.operators.index import Index, vocabulary
from impactrank.sources import growth
from pyspark.sql import functions as F


def frame(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")


def state_of(index, terms):
    ranked = R.rank(terms, index, 50).select("query_id", "rank", "docid", "rsv")
    return [sorted(map(tuple, df.collect())) for df in (index.heads.select("term", "impact", "freq"), index.posts.select("term", "docid", "impact"), index.docs.select("docid", "docno"), vocabulary(index.heads), ranked)]


@pytest.mark.parametrize("tier", [0, 2])
def test_a_grown_index_equals_a_rebuilt_one(spark, tmp_path, tier):
    """Documents come, change, go and come back; generations are never merged, or merged by size."""
    chance = random.Random(tier % 97)
    path, now = str(tmp_path / "i"), {}
    terms = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "c")], "query_id long, term_pos int, term string")
    text = lambda: " ".join(chance.choices("abcdef", k=chance.randint(0, 8)))
    for turn, (ids, gone) in enumerate([(range(12), []), ([3, 12, 13], [0, 99]), ([], [3, 4]), ([0, 4, 13], [1])]):
        new = {i: text() for i in ids}
        growth.change(spark, path, frame(spark, new) if new else None, spark.createDataFrame([(i,) for i in gone], "docid long") if gone else None, merge=False)
        now = {i: t for i, t in now.items() if i not in gone} | new
        if tier:
            growth.merge_tiers(spark, path, tier)
        if turn:
            rebuilt = Index.over(frame(spark, now))
            assert state_of(growth.read_grown(spark, path), terms) == state_of(rebuilt, terms), turn
    few = growth.read_grown(spark, path, terms)
    assert {r.term for r in few.heads.collect()} <= set("abc") and sorted(map(tuple, R.rank(terms, few, 50).collect())) == sorted(map(tuple, R.rank(terms, rebuilt, 50).collect()))
    assert len(growth._generations(spark, path)[1]) == 4 if not tier else len(growth._generations(spark, path)[1]) < 4


def test_a_change_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    growth.change(spark, path, frame(spark, {1: "a b", 2: "b"}))
    before = sorted(map(tuple, growth.read_grown(spark, path).posts.collect()))

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(growth, "_listed", broken)
    with pytest.raises(RuntimeError):
        growth.change(spark, path, frame(spark, {1: "c", 3: "d"}))
    assert sorted(map(tuple, growth.read_grown(spark, path).posts.collect())) == before
    assert growth.read_grown(spark, path).docs.agg(F.count("*")).first()[0] == 2


def test_a_generation_is_built_from_arrays(spark, tmp_path, monkeypatch):
    seen, real = [], growth.write_index
    monkeypatch.setattr(growth, "write_index", lambda index, path, *more: seen.append(index.bodies) or real(index, path, *more))
    growth.change(spark, str(tmp_path / "i"), frame(spark, {1: "a b", 2: "b b"}))
    assert seen[0] is not None and growth.read_grown(spark, str(tmp_path / "i")).posts.count() == 3
