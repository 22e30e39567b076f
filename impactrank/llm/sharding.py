"""Consistent-hash sharding with bounded loads, in DataFrame functions alone.

Each shard owns ``virtual`` points of a hash ring; a row belongs to the next point clockwise of its
hash. Loads are bounded by exact capacities, so shard counts end at most one apart: the rows of a
point fill its shard first; rows over the capacity wait in ring order and go to the next points
clockwise whose shards have room. Which row goes where follows from its rank in its arc alone, and
ranks come from counts per hash range, so no task sees more than a range of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Points of a shard on the ring.
VIRTUAL = 64
#: Cells of the ring; a row looks for its point in the short list of its cell.
CELL_BITS = 12
#: Rows that one task ranks, about.
RANGE_ROWS = 200_000
#: Equal rows that share a place on the ring; more of them get several places, so that no range holds them all.
COPIES = 1000


def ring(spark: SparkSession, shards: int, virtual: int) -> DataFrame:
    """(arc, at, shard): the points in ring order; shards * virtual rows, whatever the input holds."""
    shard = F.col("id") % shards
    points = spark.range(shards * virtual).select(shard.cast("int").alias("shard"), _hash(F.lit("point"), shard, F.floor(F.col("id") / shards)).alias("at"))
    return points.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at", "shard")) - 1).alias("arc"), "at", "shard")


def _hash(*columns: Column) -> Column:
    """A place on the ring: 0 to 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def _cells(points: DataFrame, n_points: int) -> DataFrame:
    """(cell, near): for each cell the points in it in ring order, then the first one after it."""
    width = 62 - CELL_BITS
    every = points.agg(F.sort_array(F.collect_list(F.struct("at", "arc"))).alias("points"))
    cells = every.select(F.explode(F.sequence(F.lit(0), F.lit((1 << CELL_BITS) - 1))).alias("cell"), "points")
    low, high = F.shiftleft(F.col("cell").cast("long"), width), F.shiftleft((F.col("cell") + 1).cast("long"), width)
    inside = F.filter("points", lambda p: (p["at"] >= low) & (p["at"] < high))
    after = F.coalesce(F.try_element_at(F.filter("points", lambda p: p["at"] >= high), F.lit(1)), F.element_at("points", 1))
    return cells.select("cell", inside.alias("inside"), after["arc"].alias("after"))


def _placements(arcs: DataFrame, shards: int) -> DataFrame:
    """(arc, shard, taken, slot, waiting, moves) of each arc, from (arc, shard, n, cap).

    The first ``taken`` rows of an arc stay with its shard, from ``slot`` on. The others queue from
    ``waiting`` on; ``moves`` holds the (start, stop, shard, slot) ranges of the queue that meet them.
    """
    before = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    own = arcs.withColumn("slot", F.least(F.coalesce(F.sum("n").over(before), F.lit(0)), F.col("cap")))
    own = own.withColumn("taken", F.least(F.col("n"), F.col("cap") - F.col("slot")))
    in_ring = Window.partitionBy(F.lit(0)).orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("waiting", F.coalesce(F.sum(F.col("n") - F.col("taken")).over(in_ring), F.lit(0)))
    step = F.struct("arc", "shard", (F.col("n") - F.col("taken")).alias("over"))
    whole = own.agg(F.sort_array(F.collect_list(step)).alias("steps"), F.sort_array(F.collect_set(F.struct("shard", "cap"))).alias("caps"), F.collect_list(F.struct("shard", "taken")).alias("filled"))
    free = F.transform("caps", lambda c: c["cap"] - F.aggregate(F.filter("filled", lambda f: f["shard"] == c["shard"]), F.lit(0).cast("long"), lambda a, f: a + f["taken"]))
    whole = whole.select(F.transform("caps", lambda c: c["cap"]).alias("caps"), free.alias("free"), F.concat("steps", F.transform("steps", lambda s: F.struct(s["arc"], s["shard"], F.lit(0).cast("long").alias("over")))).alias("laps"))
    kind = "struct<free: array<bigint>, carry: bigint, done: bigint, moves: array<struct<start: bigint, stop: bigint, shard: int, slot: bigint>>>"
    begin = F.struct(F.col("free").alias("free"), F.lit(0).cast("long").alias("carry"), F.lit(0).cast("long").alias("done"), F.array().cast("array<struct<start: bigint, stop: bigint, shard: int, slot: bigint>>").alias("moves"))

    def onward(state: Column, s: Column) -> Column:
        carry, room = state["carry"] + s["over"], F.element_at(state["free"], s["shard"] + 1)
        take = F.least(carry, room)
        move = F.struct(state["done"].alias("start"), (state["done"] + take).alias("stop"), s["shard"].alias("shard"), (F.element_at(F.col("caps"), s["shard"] + 1) - room).alias("slot"))
        return F.struct(
            F.transform(state["free"], lambda x, i: F.when(i == s["shard"], x - take).otherwise(x)).alias("free"),
            (carry - take).alias("carry"),
            (state["done"] + take).alias("done"),
            F.when(take > 0, F.concat(state["moves"], F.array(move))).otherwise(state["moves"]).alias("moves"),
        ).cast(kind)

    swept = whole.select(F.aggregate("laps", begin.cast(kind), onward, lambda s: s["moves"]).alias("all_moves"))
    end = F.col("waiting") + F.col("n") - F.col("taken")
    joined = own.withColumn("one", F.lit(1)).join(F.broadcast(swept.withColumn("one", F.lit(1))), "one")
    return joined.select("arc", "shard", "taken", "slot", "waiting", F.filter("all_moves", lambda m: (m["start"] < end) & (m["stop"] > F.col("waiting"))).alias("moves"))


def _at_places(rows: DataFrame) -> DataFrame:
    """The rows with their places: a hash of the row, and for every ``COPIES`` of a row that comes more often one of its own."""
    whole = ["doc_id", "text_crc32", "size"]
    common = rows.groupBy(*whole).agg(F.count("*").alias("n")).where(F.col("n") > COPIES).select(*(F.col(c).alias(f"c_{c}") for c in whole), F.ceil(F.col("n") / COPIES).alias("places"))
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in whole]
    own = rows.withColumn("row", F.monotonically_increasing_id()).join(common, same[0] & same[1] & same[2], "left")
    spread = _hash(*whole, F.pmod("row", "places"))
    return checkpointed(own.select(*whole, F.when(F.col("places").isNull(), _hash(*whole)).otherwise(spread).alias("place")))


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", virtual: int = VIRTUAL) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; shard counts are at most one apart.

    A null text counts as empty: size 1, crc of no bytes. A null id hashes by the text alone. Repeated
    rows are placed each by itself; which of them gets which place is open, as they are alike. Equal texts under several ids are rows like any others and lie apart. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = _at_places(checkpointed(rows))
    n = rows.count()
    points = checkpointed(ring(spark, shards, virtual))
    cells = _cells(points, shards * virtual)
    width = 62 - CELL_BITS
    placed = rows.withColumn("cell", F.shiftright("place", width).cast("int")).join(F.broadcast(cells), "cell")
    nearest = F.try_element_at(F.filter("inside", lambda p: p["at"] >= F.col("place")), F.lit(1))
    bits = max(0, (n // RANGE_ROWS).bit_length())
    placed = placed.select("doc_id", "size", "text_crc32", "place", F.coalesce(nearest["arc"], F.col("after")).alias("arc"), F.shiftright("place", 62 - bits).alias("range"))
    ranges = placed.groupBy("arc", "range").agg(F.count("*").alias("n"))
    ranges = checkpointed(ranges)
    caps = F.lit(n // shards).cast("long") + (F.col("shard") < n % shards).cast("long")
    arcs = points.join(ranges.groupBy("arc").agg(F.sum("n").alias("n")), "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).alias("n"), caps.alias("cap"))
    plan = checkpointed(_placements(arcs, shards))
    earlier = Window.partitionBy("arc").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranges.select("arc", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "range").orderBy("place", "doc_id", "text_crc32", "size")))
    ranked = ranked.join(begins, ["arc", "range"]).withColumn("rank", F.col("begin") + F.col("rank") - 1).join(F.broadcast(plan), "arc")
    queued = F.col("waiting") + F.col("rank") - F.col("taken")
    move = F.try_element_at(F.filter("moves", lambda m: (m["start"] <= queued) & (m["stop"] > queued)), F.lit(1))
    stays = F.col("rank") < F.col("taken")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(stays, F.col("shard")).otherwise(move["shard"]).cast("int").alias("shard"),
        F.when(stays, F.col("slot") + F.col("rank")).otherwise(move["slot"] + queued - move["start"]).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
