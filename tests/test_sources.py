import pytest
from impactrank.operators.index import Index
from impactrank.operators.rank import named, rank
from impactrank.sources import indexio, runs, topics
from impactrank.streaming.ranking import rank_stream
from pyspark.sql import functions as F

#: Records as the readers take them, each with something that may go wrong: labels, line breaks inside a field, empty fields, tags in capitals, a record without a number.
SGML = """<top>
<num> Number: 8
<title>
  amber   beads
<desc> Description:
Which beads float?
Say why.
<narr> Narrative:
</top>
<TOP>
<NUM> 13
<TITLE> kelp
<DESC> seaweed farms
<NARR> any
</TOP>
<top>
<num> Number: none
<title> nobody's
</top>
"""
XML = """<topicset>
<topic number="4" type="plain"><query>kelp</query><description>
  seaweed  farms </description></topic>
<topic number="6" type="split"><query>amber beads</query>
<subtopic number="1" type="p">which float</subtopic><subtopic number="2" type="q"> which sink </subtopic><description>why</description></topic>
</topicset>
"""
#: A text for each branch of the rules for tokens and stems, and what it gives.
BRANCHES = {
    "skies flies": ["sky", "fly"],  # ies: y
    "boxes plates": ["box", "plat"],  # es goes
    "lamps glass": ["lamp", "glas"],  # s goes, once
    "kelp": ["kelp"],  # nothing goes
    "b2b 3d": ["b", "2", "b", "3", "d"],  # letters and digits part
    "it's s es ies": ["it", "y"],  # stems that come out empty are left out
    "RED red Red": ["red", "red", "red"],  # repeats stay, case goes
    "a-b_c, d.": ["a", "b", "c", "d"],  # other characters part
    "": [],
}


def test_each_branch_of_tokens_and_stems(spark):
    frame = spark.createDataFrame(list(enumerate(BRANCHES)), "number long, title string")
    got = {r.query_id: r.terms for r in topics.topic_queries(frame).collect()}
    assert [got[i] for i in range(len(BRANCHES))] == list(BRANCHES.values())


def test_sgml_topics(spark, tmp_path):
    (tmp_path / "t").write_text(SGML)
    rows = topics.read_sgml_topics(spark, str(tmp_path / "t")).orderBy("number").collect()
    assert [(r.number, r.title, r.description) for r in rows] == [(8, "amber beads", "Which beads float? Say why."), (13, "kelp", "seaweed farms")]
    assert rows[0].narrative == ""
    both = topics.topic_queries(topics.read_sgml_topics(spark, str(tmp_path / "t")), "td").where("query_id = 8").first()
    assert both.terms == ["amber", "bead", "which", "bead", "float", "say", "why"]


def test_xml_topics(spark, tmp_path):
    (tmp_path / "t.xml").write_text(XML)
    rows = topics.read_xml_topics(spark, str(tmp_path / "t.xml")).orderBy("number").collect()
    assert [(r.number, r.type, r.query, r.description) for r in rows] == [(4, "plain", "kelp", "seaweed farms"), (6, "split", "amber beads", "why")]
    assert [[(s["number"], s["type"], s["text"]) for s in r.subtopics] for r in rows] == [[], [(1, "p", "which float"), (2, "q", "which sink")]]


def test_query_lines_round_trip(spark, tmp_path):
    """Blank lines are no queries; an id is the number that a line begins with, or 0; runs of blanks part words once; a line may have no terms."""
    lines = spark.createDataFrame([("5 red  kelp",), ("\t12\tred\r",), (" ",), ("",), ("none red",), ("7",)], "value string")
    got = sorted((r.query_id, r.term_pos, r.term) for r in topics.query_terms(lines).collect())
    assert got == [(0, 0, "red"), (5, 0, "red"), (5, 1, "kelp"), (12, 0, "red")]
    kept = spark.createDataFrame([(5, ["red", "kelp", "red"]), (12, ["sand"])], "query_id long, terms array<string>")
    topics.write_queries(kept, str(tmp_path / "q"))
    assert {r.term for r in topics.read_term_list(spark, str(tmp_path / "q")).collect()} == {"red", "kelp", "sand"}
    back = topics.read_queries(spark, str(tmp_path / "q")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term_pos", "term"))).alias("t"))
    assert {r.query_id: [t.term for t in r.t] for r in back.collect()} == {5: ["red", "kelp", "red"], 12: ["sand"]}


def test_index_and_run_round_trip(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = Index.over(docs)
    indexio.write_index(index, str(tmp_path / "i"), 3)
    terms = topics.query_terms(spark.createDataFrame([("1 the of anea the",), ("2 de la",)], "value string"))
    for back in (indexio.read_index(spark, str(tmp_path / "i")), indexio.read_index(spark, str(tmp_path / "i"), terms)):
        want = rank(terms, index, 7).collect()
        assert sorted(rank(terms, back, 7).collect()) == sorted(want)
    assert indexio.read_vocabulary(spark, str(tmp_path / "i")).count() == index.heads.select("term").distinct().count()
    bodies = indexio.read_bodies(spark, str(tmp_path / "i"))
    assert sum(r.freq for r in bodies.collect()) == index.posts.count()
    run = named(rank(terms, index, 3), index.docs)
    assert runs.timed_run(run, str(tmp_path / "timed")) > 0
    runs.write_run(run, str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    first = run.where("query_id = 1 and rank = 1").first()
    assert len(lines) == 6 and f"1 Q0 doc-{first.docid} 1 {first.rsv} COMPILED (ID:{first.docid})" in lines


def scan_of(frame):
    """The file scan of a plan that has run."""
    plan = frame._jdf.queryExecution().executedPlan()
    while not plan.children().isEmpty():
        plan = plan.children().head()
    return plan


@pytest.mark.parametrize("n_terms", [1, 40, 1100, 5000])
def test_a_batch_reads_the_folders_of_its_terms_only(spark, wide_index, n_terms):
    """Also where the terms are thousands: files read are those of the terms' folders, fewer than stored."""
    chosen = spark.range(n_terms).select(F.concat(F.lit("w"), F.col("id") * 7).alias("term"))
    touched = chosen.select(indexio.bucket(F.col("term"), 2048)).distinct().count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = indexio.read_bodies(spark, wide_index, chosen)
        assert {r.term for r in found.select("term").collect()} == {f"w{7 * i}" for i in range(n_terms)}
        scanned = indexio.read_bodies(spark, wide_index, chosen).select("term", "impact", "freq")
        scanned.collect()
        metrics = scan_of(scanned).metrics()
        assert metrics.apply("numFiles").value() == metrics.apply("numPartitions").value() == touched < 2048
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture(scope="module")
def wide_index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide") / "i")
    posts = spark.range(40_000).select(F.concat(F.lit("w"), "id").alias("term"), F.lit(3).cast("long").alias("docid"), F.lit(1).alias("impact"))
    docs = spark.range(1).select(F.lit(3).cast("long").alias("docid"), F.lit("doc-3").alias("docno"))
    indexio.write_index(Index(posts, posts, docs), path, 1, 2048)
    return path


def test_few_terms_are_named_to_the_scan(spark, wide_index):
    terms = topics.query_terms(spark.createDataFrame([("1 w5",)], "value string"))
    plan = indexio.read_index(spark, wide_index, terms).heads._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w5)" in plan or "In(term, [w5])" in plan


def test_streamed_queries(spark, sf_dir, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1 the of\n2 de\n")
    index = Index.over(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = []
    rank_stream(spark.readStream.text(str(tmp_path / "in")), index, lambda run, _: found.extend(run.collect()), 3, checkpoint=str(tmp_path / "c")).awaitTermination(120)
    assert sorted({r.query_id for r in found}) == [1, 2] and len(found) == 6


def test_chosen_columns_only(spark):
    frame = spark.createDataFrame([(1, "q w", "d")], "number long, query string, description string").withColumn("extra", F.lit(1))
    assert topics.topic_queries(frame, "qdn").first().terms == ["q", "w", "d"]


def test_runs_say_what_they_took(spark, sf_dir, tmp_path):
    """Counts are those of the plan and of early termination, from the run itself."""
    from impactrank.operators import rank as R

    index = Index.over(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    terms = topics.query_terms(spark.createDataFrame([("1 the of anea the",), ("2 de la",), ("3 zzzq",)], "value string"))
    plan = R.segment_plan(terms, index.heads)
    for mode, budget in (("exhaustive", None), ("anytime", 300)):
        seen = runs.observed_run(terms, index, str(tmp_path / mode), 4, budget, mode)
        want = R.within_budget(plan, budget).agg(F.countDistinct("query_id"), F.count("*"), F.sum("freq")).first()
        assert [seen[c] for c in ("topics", "segments", "postings", "checks", "stops")] == [*want, 0, 0] and seen["nanoseconds"] > 0
    seen = runs.observed_run(terms, index, str(tmp_path / "early"), 4, mode="early")
    rows = R.early(terms, index, 4).where("rank = 1").collect()
    assert [seen[c] for c in ("topics", "segments", "postings", "checks", "stops")] == [len(rows), *(sum(r[c] for r in rows) for c in ("segments", "postings", "checks", "stopped"))]
    assert spark.read.text(str(tmp_path / "early")).count() == 8 and seen["checks"] > 0
    line = runs.stats_lines(plan.groupBy("query_id").agg(F.sum("freq").alias("postings_processed")), seen["nanoseconds"]).first().line
    assert int(line.rsplit(",", 1)[1]) == seen["nanoseconds"] > 0
