"""Tool-call linking for chat transcripts, in DataFrame functions alone.

Calls and results are hash-joined by (conversation, call id), put in an order in which every call
follows the calls it needs, checked against the tools' schemas, and written as canonical JSON: keys sorted, no
blanks, nulls spelled out. One record a call, so that a conversation of any length needs no single row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Turns whose calls one task numbers.
SPAN = 256
#: The turn of calls that have none: before all others.
NO_TURN = -(2**63)
#: A schema's types and the variant types that fit them.
FITS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain chats: a user's turn calls ``reply``, needs the user's turn before, and the assistant's next turn is its result."""
    key = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    said = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).where("turn is not null")
    arguments = F.to_json(F.struct(F.col("text").alias("text"), F.col("turn").alias("turn")))
    calls = said.where("role = 'user'").select("conv_id", "turn", key(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"), arguments.alias("arguments"), F.array(key(F.col("turn") - 2)).alias("needs"))
    results = said.where("role = 'assistant'").select("conv_id", "turn", key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def messages_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of tool transcripts: assistant texts {"tool_calls": [{"id", "name", "arguments", "needs"}]} and tool texts {"tool_call_id", "content"}."""
    kind = "struct<tool_calls: array<struct<id: string, name: string, arguments: string, needs: array<string>>>>"
    base = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    said = turns.where("role = 'assistant'").select(*base, F.explode(F.from_json("text", kind)["tool_calls"]).alias("c"))
    calls = said.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments"), F.coalesce("c.needs", F.array().cast("array<string>")).alias("needs"))
    answer = turns.where("role = 'tool'").select(*base, F.from_json("text", "struct<tool_call_id: string, content: string>").alias("r"))
    return calls, answer.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content")).where("call_id is not null")


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, errors) of the calls whose arguments don't fit; errors are sorted and joined by '; '."""
    wanted = schemas.select(F.col("tool").alias("s_tool"), F.col("param").alias("s_param"), F.lower("type").alias("s_type"), F.coalesce("required", F.lit(False)).alias("s_required"))
    own = calls.select("conv_id", "call_id", "tool", F.try_parse_json("arguments").alias("parsed"))
    shape = F.schema_of_variant("parsed")
    given = own.where(shape.startswith("OBJECT")).lateralJoin(calls.sparkSession.tvf.variant_explode(F.col("parsed").outer())).select("conv_id", "call_id", "tool", F.col("key").alias("param"), F.schema_of_variant("value").alias("kind"))
    fits: Column = F.lit(False)
    for name, pattern in FITS.items():
        fits = fits | ((F.col("s_type") == name) & F.col("kind").rlike(f"^{pattern}$"))
    typed = given.join(wanted, (F.col("tool") == F.col("s_tool")) & (F.col("param") == F.col("s_param")), "left")
    found = typed.select("conv_id", "call_id", F.when(F.col("s_tool").isNull(), F.concat(F.lit("unknown "), "param")).when(~fits, F.concat(F.col("param"), F.lit(" is no "), F.col("s_type"))).alias("error"))
    needed = own.where(shape.startswith("OBJECT")).join(wanted.where("s_required"), F.col("tool") == F.col("s_tool")).select("conv_id", "call_id", F.col("s_param").alias("param"))
    lacking = needed.join(given.select("conv_id", "call_id", "param"), ["conv_id", "call_id", "param"], "left_anti").select("conv_id", "call_id", F.concat(F.lit("no "), "param").alias("error"))
    odd = own.where(F.coalesce(~shape.startswith("OBJECT"), F.lit(True))).select("conv_id", "call_id", F.lit("arguments are no object").alias("error"))
    strange = own.join(wanted.select("s_tool").distinct(), F.col("tool") == F.col("s_tool"), "left_anti").select("conv_id", "call_id", F.lit("unknown tool").alias("error"))
    every = found.where("error is not null").unionByName(lacking).unionByName(odd).unionByName(strange)
    return every.groupBy("conv_id", "call_id").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("errors"))


def ordered(calls: DataFrame) -> DataFrame:
    """The calls with (late, step, cyclic): by (late, step, call_id) every call follows those that it needs.

    A call stands at its turn unless it needs one that stands there or later; then it moves right behind it. Only
    conversations with such a need are looked at: in rounds, calls whose needs are all placed are placed too, until none is
    left or those left need each other. A need (bar, more, least) says where it puts a call: ``more`` steps behind the needed one if that stands at ``bar``
    or later, else at (bar, least). A need of a call with one open need passes on to that one, which doubles its reach, so long chains take few rounds.
    """
    keys = ["conv_id", "call_id"]
    turns = calls.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn"))
    needs = calls.select(*keys, "turn", F.explode("needs").alias("need")).distinct().join(turns, ["conv_id", "need"])
    moving = checkpointed(needs.where(F.struct("need_turn") >= F.struct("turn")).select("conv_id").distinct())
    if moving.isEmpty():
        return calls.withColumns({"late": F.col("turn"), "step": F.lit(0), "cyclic": F.lit(False)})
    edges = checkpointed(needs.join(moving, "conv_id", "left_semi").select(*keys, "need", F.col("turn").alias("bar"), F.lit(1).alias("more"), F.lit(0).alias("least")))
    left = checkpointed(calls.join(moving, "conv_id", "left_semi").select(*keys, F.struct(F.col("turn").alias("late"), F.lit(0).alias("step")).alias("place")))
    behind = F.when(F.struct("at.late") >= F.struct("bar"), F.struct(F.col("at.late").alias("late"), (F.col("at.step") + F.col("more")).alias("step"))).otherwise(F.struct(F.col("bar").alias("late"), F.col("least").alias("step")))
    placed: DataFrame | None = None
    while True:
        ready = checkpointed(left.join(edges, keys, "left_anti"))
        if ready.isEmpty():
            break
        placed = ready if placed is None else checkpointed(placed.unionByName(ready))
        known = ready.select("conv_id", F.col("call_id").alias("need"), F.col("place").alias("at"))
        told = edges.join(known, ["conv_id", "need"]).select(*keys, behind.alias("to"))
        rest = checkpointed(edges.join(known, ["conv_id", "need"], "left_anti"))
        left = checkpointed(_moved(left.join(ready, keys, "left_anti"), told))
        alone = rest.groupBy(*keys).agg(F.count("*").alias("n"), *(F.first(c).alias(f"_{c}") for c in ("need", "bar", "more", "least"))).where("n = 1").drop("n")
        onward = left.select(*keys, F.col("place").alias("at")).join(alone, keys).withColumnRenamed("call_id", "need")
        reach = checkpointed(rest.join(onward, ["conv_id", "need"], "left"))
        left = checkpointed(_moved(left, reach.where("at is not null").select(*keys, behind.alias("to"))))
        higher = F.struct("_bar") >= F.struct("bar")
        edges = checkpointed(reach.select(
            *keys,
            F.when(F.col("at").isNull(), F.col("need")).otherwise(F.col("_need")).alias("need"),
            F.when(F.col("at").isNotNull() & higher, F.col("_bar")).otherwise(F.col("bar")).alias("bar"),
            F.when(F.col("at").isNull(), F.col("more")).otherwise(F.least(F.col("more").cast("long") + F.col("_more"), F.lit(2**30)).cast("int")).alias("more"),
            F.when(F.col("at").isNotNull() & higher, F.least(F.col("_least").cast("long") + F.col("more"), F.lit(2**30)).cast("int")).otherwise(F.col("least")).alias("least"),
        ).distinct())
    done = calls.select(*keys).limit(0).select(*keys, F.lit(None).cast("long").alias("late"), F.lit(0).alias("step")) if placed is None else placed.select(*keys, "place.late", "place.step")
    own = calls.join(done.withColumn("known", F.lit(True)), keys, "left").join(moving.withColumn("moving", F.lit(True)), "conv_id", "left")
    return own.withColumns({"late": F.when(F.col("known"), F.col("late")).otherwise(F.col("turn")), "step": F.coalesce("step", F.lit(0)), "cyclic": F.col("moving").isNotNull() & F.col("known").isNull()}).drop("known", "moving")


def _moved(left: DataFrame, told: DataFrame) -> DataFrame:
    """The places of calls, put off to the last that they are told."""
    last = told.groupBy("conv_id", "call_id").agg(F.max("to").alias("to"))
    later = F.col("to").isNotNull() & (F.col("to") > F.col("place"))
    return left.join(last, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.when(later, F.col("to")).otherwise(F.col("place")).alias("place"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, position, turn, tool, status, errors, result_turn, record), a row per call and per result without one.

    status: ok, invalid (errors say why), cycle (it needs itself, through others or not, or follows one that does), unanswered, or orphan for a result whose call is missing. Of calls or results that repeat an
    id in a conversation the first by turn counts (then by content). Needs of unknown ids are ignored. Null conversations are
    left out, null call ids too. Calls and results without a turn stand before all others and keep a null turn; null arguments are no object, a null tool is
    unknown, null needs are none, and a schema's parameter without a type fits every value. Empty tables give an empty result. position counts a conversation's calls from 0 in their order.
    """
    keys = ["conv_id", "call_id"]
    named = lambda df: df.where("conv_id is not null and call_id is not null")
    one = named(calls).withColumn("turn", F.coalesce("turn", F.lit(NO_TURN))).groupBy(keys).agg(F.min(F.struct("turn", "arguments", "tool", "needs")).alias("c")).select(*keys, "c.*")
    one = checkpointed(one)
    answer = named(results).groupBy(keys).agg(F.min(F.struct("turn", "content")).alias("r")).select(*keys, F.col("r.turn").alias("result_turn"), "r.content", F.lit(True).alias("answered"))
    placed = ordered(one).withColumn("span", F.floor(F.col("late") / SPAN))
    spans = placed.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    spans = spans.select("conv_id", "span", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy("late", "step", "call_id"))
    placed = placed.withColumn("within", within).join(spans, ["conv_id", "span"]).withColumn("position", F.col("before") + F.col("within") - 1)
    linked = placed.join(argument_errors(one, schemas), keys, "left").join(answer, keys, "left")
    status = F.when(F.col("cyclic"), "cycle").when(F.col("errors").isNotNull(), "invalid").when(F.col("answered").isNull(), "unanswered").otherwise("ok")
    parsed = F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(F.lit("null")))
    record = F.to_json(F.struct(parsed.alias("arguments"), F.col("call_id"), F.col("conv_id"), F.col("position"), F.col("content").alias("result"), F.col("tool")), {"ignoreNullFields": "false"})
    turn = F.when(F.col("turn") != NO_TURN, F.col("turn"))
    out = linked.select(*keys, "position", turn.alias("turn"), "tool", status.alias("status"), "errors", "result_turn", record.alias("record"))
    orphan = answer.join(one.select(keys), keys, "left_anti").select(*keys, F.lit(None).cast("long").alias("position"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("tool"), F.lit("orphan").alias("status"), F.lit(None).cast("string").alias("errors"), "result_turn", F.lit(None).cast("string").alias("record"))
    return out.unionByName(orphan)


def reply_schema(turns: DataFrame) -> DataFrame:
    """The schema of the tool ``reply`` that ``turns_as_calls`` uses."""
    rows = [("reply", "text", "string", True), ("reply", "turn", "integer", True)]
    return turns.sparkSession.range(len(rows)).select(*(F.element_at(F.array(*(F.lit(r[i]) for r in rows)), F.col("id").cast("int") + 1).alias(c) for i, c in enumerate(("tool", "param", "type", "required"))))
