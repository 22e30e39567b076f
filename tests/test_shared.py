from types import SimpleNamespace

import pytest
from impactrank import shared
from pyspark.sql import functions as F


def session_of(master, named=None):
    """A stand-in for a session that names no checkpoint folder yet."""
    held = SimpleNamespace(isEmpty=lambda: True, get=lambda: "set")
    chosen = []
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)), setCheckpointDir=chosen.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: named or default)), chosen


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    session, chosen = session_of(master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(session)
    session, chosen = session_of(master, "hdfs:///shared")
    assert shared.fresh_path(session, "x").startswith("hdfs:///shared/x-") and chosen == ["hdfs:///shared"]


def test_checkpoints_keep_rows_and_settings(spark):
    before = spark.conf.get(shared._DROP_SHUFFLES, None)
    kept = shared.checkpointed(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get(shared._DROP_SHUFFLES, None) == before
    assert kept.count() == 7 and kept.agg(F.sum("count")).first()[0] == 100
    assert kept.join(kept.withColumnRenamed("count", "n"), "k").where("count = n").count() == 7
