import random

from impactrank.llm import toolcalls as C
from impactrank.llm.queries import OP8_SQL, op8_tool_calls
from oracle import oracle_rows, rows_of

CALL = "conv_id long, turn long, call_id string, tool string, arguments string, needs array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"
SCHEMA = "tool string, param string, type string, required boolean"


def test_query_equals_oracle(spark, sf_dir):
    frame = op8_tool_calls(spark, sf_dir)
    assert rows_of(frame) == oracle_rows(sf_dir, OP8_SQL)
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


def linked(spark, calls, results, schemas):
    frame = C.link_tool_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), spark.createDataFrame(schemas, SCHEMA))
    return {(r.conv_id, r.call_id): r for r in frame.collect()}


def test_order_validation_and_records(spark):
    calls = [
        (1, 1, "a", "f", '{"y": 1, "x": "s"}', ["c"]),
        (1, 2, "b", "f", '{"x": 3}', []),
        (1, 3, "c", "g", "[1]", ["b", "nowhere"]),
        (1, 4, "d", "f", "nope", None),
        (1, 5, "e", "f", '{"y": 1.5}', []),
        (1, 9, "e", "f", '{"x": "later"}', []),
        (2, 1, "p", "f", '{"x": "q"}', ["q"]),
        (2, 2, "q", "f", '{"x": "1"}', ["p"]),
        (None, 1, "n", "f", "{}", []),
        (3, 1, None, "f", "{}", []),
    ]
    got = linked(spark, calls, [(1, 7, "a", "ra"), (1, 8, "a", "again"), (1, 6, "zz", "r")], [("f", "x", "string", True), ("f", "y", "number", False)])
    assert set(got) == {(1, k) for k in ("a", "b", "c", "d", "e", "zz")} | {(2, "p"), (2, "q")}
    assert [got[1, k].position for k in "bcade"] == [0, 1, 2, 3, 4]
    assert got[1, "a"].record == '{"arguments":{"x":"s","y":1},"call_id":"a","conv_id":1,"position":2,"result":"ra","tool":"f"}'
    assert {k: (r.status, r.errors) for (c, k), r in got.items() if c == 1} == {
        "a": ("ok", None),
        "b": ("invalid", "x is no string"),
        "c": ("invalid", "arguments are no object; unknown tool"),
        "d": ("invalid", "arguments are no object"),
        "e": ("invalid", "no x"),
        "zz": ("orphan", None),
    }
    assert got[1, "a"].result_turn == 7 and got[2, "p"].status == got[2, "q"].status == "cycle"


def test_messages(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls": [{"id": "k", "name": "f", "arguments": "{\\"x\\": \\"v\\"}"}]}'), (1, 2, "tool", '{"tool_call_id": "k", "content": "done"}'), (1, 3, "assistant", "plain"), (1, 4, "tool", None)],
        "conv_id long, turn long, role string, text string",
    )
    calls, results = C.messages_as_calls(turns)
    row = C.link_tool_calls(calls, results, spark.createDataFrame([("f", "x", "string", True)], SCHEMA)).first()
    assert (row.call_id, row.status, row.result_turn) == ("k", "ok", 2)


def test_odd_turns_and_long_conversations(spark, monkeypatch):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", ""), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 5, None, "x"), (4, 1, "assistant", "alone")]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, call_id long, late long")
    got = {(r.call_id, r.status) for r in C.link_tool_calls(*C.turns_as_calls(turns), C.reply_schema(turns)).collect()}
    assert got == {("1:0", "ok"), ("4:0", "orphan")}
    none = turns.limit(0)
    assert C.link_tool_calls(*C.turns_as_calls(none), C.reply_schema(none)).count() == 0
    monkeypatch.setattr(C, "SPAN", 4)
    calls = [(7, t, f"c{t:03}", "f", "{}", [f"c{t - 1:03}"]) for t in range(50)]
    got = linked(spark, calls, [], [("f", "x", "string", False)])
    assert [got[7, f"c{t:03}"].position for t in range(50)] == list(range(50))


def test_long_reversed_chains_and_cycles(spark):
    """Chains that need the next call, a long cycle with a tail, and random needs against a recursive order; each conversation on its own."""
    call = lambda conv, t, needs: (conv, t, f"c{t:03}", "f", "{}", [f"c{n:03}" for n in needs])
    calls = [call(1, t, [t + 1]) for t in range(20)] + [call(2, t, [t + 1]) for t in range(100)]
    calls += [call(3, t, [(t + 1) % 12]) for t in range(12)] + [call(3, 12, [5]), call(3, 13, [])]
    chance = random.Random(5)
    for conv in range(4, 10):
        turn = chance.sample(range(14), 14)
        calls += [call(conv, turn[i], [turn[j] for j in chance.sample(range(i), min(i, chance.randint(0, 3)))]) for i in range(14)]
    got = linked(spark, calls, [], [("f", "x", "string", False)])
    assert [got[2, f"c{t:03}"].position for t in range(100)] == [*range(99, -1, -1)]
    assert [got[1, f"c{t:03}"].position for t in range(20)] == [*range(19, -1, -1)]
    assert {k for k, r in got.items() if r.status == "cycle"} == {(3, f"c{t:03}") for t in range(13)}
    for conv in range(4, 10):
        own = {c[2]: c for c in calls if c[0] == conv}

        def place(name):
            last = max([place(n) for n in own[name][5]], default=(-1, 0))
            return (last[0], last[1] + 1) if last >= (own[name][1], 0) else (own[name][1], 0)

        want = sorted(own, key=lambda n: (*place(n), n))
        assert sorted(own, key=lambda n: got[conv, n].position) == want


def test_nulls_in_every_column(spark):
    """Calls without turn, tool, arguments or needs, or with null, empty and repeated needs, stay; a result without a turn or text is a result."""
    calls = [
        (1, None, "a", "f", '{"x": "1"}', None),
        (1, 0, "b", None, '{"x": "1"}', []),
        (1, 1, "c", "f", None, [None, "", "d", "d"]),
        (1, 2, "d", "f", "", ["a", None]),
        (1, 3, "e", "f", "null", ["a"]),
        (1, None, "g", "f", '{"x": null, "z": 1}', ["b"]),
        (1, 4, "g", "f", '{"x": "later"}', []),
        (1, 5, "", "f", '{"x": "1"}', []),
    ]
    schemas = [("f", "x", "string", True), ("f", "z", None, None), (None, "x", "string", True), ("f", None, "string", False)]
    got = linked(spark, calls, [(1, None, "a", None), (1, 6, "e", None), (1, None, "none", "r"), (None, 1, "a", "r"), (1, 1, None, "r")], schemas)
    assert set(got) == {(1, k) for k in ("a", "b", "c", "d", "e", "g", "", "none")}
    assert [got[1, k].position for k in ("a", "b", "g", "d", "e", "", "c")] == list(range(7))
    assert {k: (r.status, r.errors) for (_, k), r in got.items()} == {
        "a": ("ok", None),
        "b": ("invalid", "unknown tool; unknown x"),
        "c": ("invalid", "arguments are no object"),
        "d": ("invalid", "arguments are no object"),
        "e": ("invalid", "arguments are no object"),
        "g": ("invalid", "x is no string"),
        "": ("unanswered", None),
        "none": ("orphan", None),
    }
    assert got[1, "a"].turn is None and got[1, "a"].result_turn is None and got[1, "g"].turn is None and got[1, "d"].turn == 2
    assert got[1, "e"].record == '{"arguments":null,"call_id":"e","conv_id":1,"position":4,"result":null,"tool":"f"}'
