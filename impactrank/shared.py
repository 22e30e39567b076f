"""The cluster's shared folder, named by ``spark.checkpoint.dir``: checkpoints, and tables that one job writes and others read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names. A folder of our own serves where none is named and all runs in one process, as in tests; a cluster must name one."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and held.isEmpty():
        context.setCheckpointDir(named)
    elif held.isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="impactrank-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The public setting by which Spark drops a job's shuffle files at its end; a checkpoint makes them needless.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Computed now and kept in the shared folder, its lineage cut and the shuffle files of the computation dropped."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew, under the setting
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Computed now and kept as Parquet in the shared folder. Unlike a checkpoint, what is read back carries no constraints of the plan that made it, so loops don't pile them up."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
