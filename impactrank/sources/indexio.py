"""An index as Parquet: narrow headers apart from bodies, in folders by hash of the term, so that a batch of any size reads the folders of its terms only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactrank.operators.index import Index, block_cuts, segment_postings, vocabulary, with_heads
from impactrank.shared import written

#: Postings of a folder, about, and the most folders.
BUCKET_POSTINGS, MOST_BUCKETS = 1 << 20, 1 << 16

#: Terms of a batch up to which they are sent to every task, so that bodies needn't be shuffled to meet them.
SENT_TERMS = 1 << 17

#: Columns of the parts in folders; an index of no postings has no folder to tell them.
_SCHEMAS = {"bodies": "term string, impact int, block long, docids array<long>, freq long, pos long, before array<long>, bucket int", "segments": "term string, impact int, freq long, bucket int"}


def _read(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[part]).parquet(f"{path}/{part}")


def bucket(term: Column, buckets: int) -> Column:
    """The folder of a term."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(index: Index, path: str, partitions: int | None = None, buckets: int | None = None) -> None:
    """Write bodies, headers, vocabulary and document list. Folders are as many as the postings need; within them rows are sorted by term, so a reader skips row groups too. Postings are computed once: the rest is read from the bodies."""
    spark = index.posts.sparkSession
    cuts = block_cuts(index.docs) if index.cuts is None else index.cuts
    bodies = written((segment_postings(index.posts, cuts) if index.bodies is None else index.bodies).withColumn("freq", F.size("docids").cast("long")), "bodies")
    total = bodies.agg(F.sum("freq")).first()[0] or 0
    buckets = buckets or min(MOST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, total) / BUCKET_POSTINGS))))

    def write(df: DataFrame, part: str, *keys: str) -> None:
        own = df.withColumn("bucket", bucket(F.col("term"), buckets))
        spread = own.repartitionByRange(partitions, "bucket", *keys) if partitions else own.repartitionByRange("bucket", *keys)
        spread.sortWithinPartitions("bucket", "term", F.desc("impact")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{part}")

    headed = with_heads(bodies) if cuts else bodies.withColumns({"pos": F.lit(0).cast("long"), "before": F.array().cast("array<bigint>")})
    write(headed, "bodies", "term", "impact", "block")
    write(_read(spark, path, "bodies").groupBy("term", "impact").agg(F.sum("freq").alias("freq")), "segments", "term", "impact")
    vocabulary(_read(spark, path, "segments")).sort("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>").alias("cuts") if cuts else F.array().cast("array<bigint>").alias("cuts")).write.mode("overwrite").parquet(f"{path}/layout")


def _of_terms(spark: SparkSession, path: str, part: str, qterms: DataFrame | None) -> DataFrame:
    """A part of the index, or the rows of a batch's terms in it. The folders to read are named to the scan: they are at most ``MOST_BUCKETS`` numbers, however many the terms.

    Terms too few for Spark to turn their filter into a range are also named, so that row groups are skipped by their statistics.
    """
    rows = _read(spark, path, part)
    if qterms is not None:
        buckets = spark.read.parquet(f"{path}/layout").first()[0]
        terms = qterms.select("term").distinct()
        touched = [r[0] for r in terms.select(bucket(F.col("term"), buckets).alias("bucket")).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(touched)) if len(touched) < buckets else rows
        few = int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold"))
        named = [r[0] for r in terms.limit(few + 1).collect()]
        if len(named) > few and terms.count() <= SENT_TERMS:
            terms = F.broadcast(terms)
        rows = rows.where(F.col("term").isin(named)) if len(named) <= few else rows.join(terms, "term", "left_semi")
    return rows.drop("bucket")


def read_index(spark: SparkSession, path: str, qterms: DataFrame | None = None) -> Index:
    """The index, or what a query batch needs of it."""
    heads, bodies = (_of_terms(spark, path, part, qterms) for part in ("segments", "bodies"))
    cuts = spark.read.parquet(f"{path}/layout").first()["cuts"]
    return Index(heads, bodies.select("term", "impact", F.explode("docids").alias("docid")), spark.read.parquet(f"{path}/docs"), bodies, cuts)


def postings_of(spark: SparkSession, path: str) -> int:
    """How many postings a stored index has."""
    return _read(spark, path, "segments").agg(F.sum("freq")).first()[0] or 0


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vocabulary")


def read_bodies(spark: SparkSession, path: str, qterms: DataFrame | None = None) -> DataFrame:
    """(term, impact, block, docids, freq, pos, before), as they are stored: pos postings of the segment come before the block, the last of them before."""
    return _of_terms(spark, path, "bodies", qterms)
