"""Docid gaps of segments and their inverses.

A block of a segment is one row, which also says how many postings of the segment come before it and what the last docids there are; so gaps are
taken within the row, whatever the segment's size, and undone by running sums within a block. Rows of single gaps, which lack such heads, are undone by sums that are carried from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import BODY_BITS, TAIL, segment_postings, with_heads

SEGMENT = ["term", "impact"]


def _lead(stride: int) -> Column:
    """The ``stride`` docids before a block; zeros where the segment has fewer."""
    if not 1 <= stride <= TAIL:
        raise ValueError(f"blocks know the last {TAIL} docids before them; no gaps of stride {stride}")
    return F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), stride), F.coalesce("before", F.array().cast("array<long>"))), -stride, stride)


def block_gaps(bodies: DataFrame, stride: int = 1) -> DataFrame:
    """(term, impact, block, pos, before, docids, gaps) of bodies with heads: each docid less the one ``stride`` places earlier; the first ones as they are."""
    earlier = F.slice(F.concat(_lead(stride), "docids"), F.lit(1), F.size("docids"))
    return bodies.select(*SEGMENT, "block", "pos", "before", "docids", F.zip_with("docids", earlier, lambda d, e: d - e).alias("gaps"))


def gap_rows(coded: DataFrame) -> DataFrame:
    """(term, impact, docid, pos, gap), a row a posting; pos counts from 0 in the segment."""
    each = coded.select(*SEGMENT, "pos", F.posexplode(F.arrays_zip("docids", "gaps")).alias("i", "x"))
    return each.select(*SEGMENT, F.col("x.docids").alias("docid"), (F.col("pos") + F.col("i")).alias("pos"), F.col("x.gaps").alias("gap"))


def from_block_gaps(coded: DataFrame, stride: int = 1) -> DataFrame:
    """(term, impact, docid) from blocks of gaps and their heads: ``stride`` interleaved running sums in each block."""
    each = coded.select(*SEGMENT, "block", _lead(stride).alias("lead"), F.posexplode("gaps").alias("i", "gap")).withColumn("lane", F.col("i") % stride)
    upto = Window.partitionBy(*SEGMENT, "block", "lane").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select(*SEGMENT, (F.get("lead", F.col("lane")) + F.sum("gap").over(upto)).alias("docid"))


def gaps(posts: DataFrame, stride: int = 1) -> DataFrame:
    """(term, impact, docid, pos, gap) of postings rows."""
    return gap_rows(block_gaps(with_heads(segment_postings(posts)), stride))


def _carried(rows: DataFrame, keys: list[str], block: Column, order: str, value: Column, name: str) -> DataFrame:
    """Rows with ``name``: the running sum of ``value`` by ``order`` within ``keys``; ``block`` rises with ``order``."""
    own = rows.withColumns({"_block": block, "_value": value})
    whole = own.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(*keys, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    upto = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = own.withColumn("_within", F.sum("_value").over(upto)).join(before, [*keys, "_block"])
    return summed.withColumn(name, F.col("_before") + F.col("_within")).drop("_block", "_value", "_before", "_within")


def from_gaps(coded: DataFrame, stride: int = 1) -> DataFrame:
    """Docids back from rows (term, impact, pos, gap): ``stride`` interleaved running sums."""
    laned = coded.withColumn("_lane", F.col("pos") % stride)
    return _carried(laned, [*SEGMENT, "_lane"], F.shiftright("pos", BODY_BITS), "pos", F.col("gap"), "docid").drop("_lane")
