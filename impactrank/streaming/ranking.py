"""A stream of query lines against a static index, and statistics of the stream itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from impactrank.functions import text as T
from impactrank.operators.index import Index
from impactrank.operators.rank import named, rank
from impactrank.sources.topics import query_terms


def rank_stream(lines: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], k: int = 10, budget: int | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Rank each micro-batch of query lines as one batch of queries and hand its run to ``sink``.

    Ranking needs windows over whole queries, which a stream itself doesn't offer, so each micro-batch is
    ranked as a static frame; a query is one line, so no query is split between batches.
    """

    def batch(frame: DataFrame, number: int) -> None:
        mode = "exhaustive" if budget is None else "anytime"
        sink(named(rank(query_terms(frame), index, k, budget, mode), index.docs), number)

    writer = lines.writeStream.foreachBatch(batch).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def distinct_lines(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Lines (time, value) without those whose text has come before within ``late``, also in an earlier batch or before a restart. State is kept for that long, no longer.

    Blank lines are left out. Rows later than the watermark are dropped, as no state says any more what has come.
    """
    own = lines.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "").withWatermark("time", late)
    return own.dropDuplicatesWithinWatermark(["value"])


def stream_statistics(lines: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(begin, end, queries, terms, longest) of distinct lines in windows of time; a window's row comes once the watermark has passed it."""
    own = distinct_lines(lines, late).select("time", (F.size(T.words(F.col("value"))) - 1).alias("n"))
    found = own.groupBy(F.window("time", every)).agg(F.count("*").alias("queries"), F.sum("n").alias("terms"), F.max("n").alias("longest"))
    return found.select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "queries", "terms", "longest")
