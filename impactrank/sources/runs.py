"""Runs as text lines of the evaluation format, and statistics lines."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from impactrank.operators.index import Index
from impactrank.operators.rank import named, rank
from impactrank.shared import written


def run_lines(run: DataFrame) -> DataFrame:
    """(query_id, rank, line) of a named run; the tag is a fixed value."""
    line = F.format_string("%d Q0 %s %d %d COMPILED (ID:%d)", "query_id", "docno", "rank", "rsv", "docid")
    return run.select("query_id", "rank", line.alias("line"))


def write_run(run: DataFrame, path: str) -> None:
    run_lines(run).sort("query_id", "rank").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def timed_run(run: DataFrame, path: str) -> int:
    """Write the run of a batch and say how many nanoseconds that took, ranking included."""
    began = time.perf_counter_ns()
    write_run(run, path)
    return time.perf_counter_ns() - began


def observed_run(qterms: DataFrame, index: Index, path: str, k: int = 10, budget: int | None = None, mode: str = "exhaustive", strict: bool = True) -> dict[str, int]:
    """Rank a batch, write its run, and say what that took: topics, segments, postings, checks, stops, nanoseconds.

    The counts are observed while the run is made; no second job makes them. The run is kept as a table before it is sorted, as a sort reads its input twice.
    """
    began = time.perf_counter_ns()
    watch = Observation()
    write_run(written(named(rank(qterms, index, k, budget, mode, strict, watch), index.docs), "run"), path)
    return {**{name: int(value or 0) for name, value in watch.get.items()}, "nanoseconds": time.perf_counter_ns() - began}


def stats_lines(stats: DataFrame, nanoseconds: int = 0) -> DataFrame:
    """(query_id, line): id, postings processed, and time. Spark ranks a batch as one job, so each line has the time of the whole batch, as ``timed_run`` measures it; 0 if none is given."""
    line = F.format_string("query id,postings processed,ns:%d,%d,%d", F.col("query_id"), F.col("postings_processed"), F.lit(nanoseconds).cast("long"))
    return stats.select("query_id", line.alias("line"))
