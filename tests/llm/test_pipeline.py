import corpus_pipeline
import numpy as np
import pyarrow as pa
from conftest_data import table
from impactrank.llm import common, features, pu, rules
from impactrank.llm.common import words
from test_decontaminate import brute_leaks
from test_packing import brute_pieces, check_layout, pieces_of
from test_simhash import brute_groups


def test_run_equals_brute_force(spark, sf_dir, labels):
    """Stage by stage with the same models, a document at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = pu.train(docs, labels).astype(np.float32)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r in rows if (features.matrix(words([r[1].encode()])) @ weights >= 0)[0]]
    first = docs.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long"), "doc_id", "left_semi")
    model = rules.train(first, labels)
    rows = [r for r in rows if model.verdicts([r[1].encode()])[2][0]]
    names = dict(brute_groups(rows))
    rows = [r for r in rows if r[0] == names[r[0]]]
    leaky = {d for d, *_ in brute_leaks(rows, [(r["item_id"], r["text"]) for r in table(sf_dir, "benchmark")])}
    rows = [r for r in rows if r[0] not in leaky]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and pieces_of(got) == brute_pieces(rows)
    check_layout(got, 4096)


def test_stages_keep_the_columns(spark, sf_dir, odd):
    docs = odd.select("doc_id", "text", "lang")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            kept = stage(spark, frame, sf_dir)
            assert kept.columns == docs.columns
            assert kept.count() <= frame.count()


def test_stages_run_in_small_batches(spark, sf_dir, odd):
    """A batch of texts ends at some megabytes; by default one holds all of these."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    corpus_pipeline.benchmark_decontamination(spark, odd.select("doc_id", "text"), sf_dir)
    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 10000) as text")
    got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert len(got) > 3 and max(got) < 8 << 20


def test_tasks_give_memory_back(monkeypatch):
    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append("back"))
    assert [*common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2])), *said] == [2, 4, "back"]
