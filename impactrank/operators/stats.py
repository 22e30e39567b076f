"""Work statistics of query batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_stats(plan: DataFrame) -> DataFrame:
    """(query_id, segments_processed, postings_processed) of the chosen segments."""
    return plan.groupBy("query_id").agg(F.count("*").alias("segments_processed"), F.sum("freq").alias("postings_processed"))


def summary(stats: DataFrame) -> DataFrame:
    """One row of totals and whole-number averages; averages of no queries are null."""
    n = F.count("*")
    mean = lambda c: F.when(n > 0, F.floor(F.sum(c) / n)).cast("long")
    return stats.agg(
        n.alias("topics"),
        F.sum("segments_processed").alias("total_segments"),
        F.sum("postings_processed").alias("total_postings"),
        mean("segments_processed").alias("mean_segments"),
        mean("postings_processed").alias("mean_postings"),
    )
