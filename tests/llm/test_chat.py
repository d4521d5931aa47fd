import json

import duckdb
from pyspark.sql import functions as F

from pagelathe.llm import chat

FIELDS = "conv_id long, turn long, role string, text string"


def call(id, name, arguments, after=None):
    return "<tool_call>" + json.dumps({"name": name, "id": id, "arguments": arguments} | ({"after": after} if after else {})) + "</tool_call>"


def result(id, content):
    return json.dumps({"tool_call_id": id, "content": content})


def run(spark, rows, fields=FIELDS, tools=chat.TOOLS):
    return [r.asDict() for r in chat.formatted(spark.createDataFrame(rows, fields), tools).orderBy("conv_id", "place_turn", "place_depth", "turn").collect()]


def test_links_and_canonical_json(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "look " + call("a", "search", {"query": "x", "limit": 2})), (1, 2, "tool", result("a", {"b": 1, "a": [2]}))]
    out = run(spark, rows)
    assert [r["n_linked"] for r in out] == [0, 1, 1]
    assert out[0]["message"] == '{"content":"hi","role":"user"}'
    assert out[1]["message"] == '{"calls":[{"arguments":{"limit":2,"query":"x"},"id":"a","name":"search"}],"content":"look","role":"assistant"}'
    assert out[2]["message"] == '{"result":{"a":[2],"b":1},"role":"tool","tool_call_id":"a"}'
    assert all(r["problems"] == "" for r in out)


def test_order_is_topological(spark):
    # the result of `a` stands before its call, and `b` waits for `a`
    rows = [(1, 0, "tool", result("a", 1)), (1, 1, "assistant", call("b", "calculate", {"expression": "1"}, ["a"])), (1, 2, "assistant", call("a", "search", {"query": "x"})), (1, 3, "user", "bye")]
    assert [r["turn"] for r in run(spark, rows)] == [2, 0, 1, 3]


def test_cycles_are_flagged(spark):
    rows = [(1, 0, "assistant", call("a", "search", {"query": "x"}, ["b"])), (1, 1, "tool", result("a", 1)), (1, 2, "assistant", call("b", "search", {"query": "x"}, ["a"])), (1, 3, "tool", result("b", 1)), (2, 0, "user", "x")]
    assert [(r["turn"], r["cyclic"]) for r in run(spark, rows)] == [(0, True), (1, True), (2, True), (3, True), (0, False)]


def test_problems(spark):
    rows = [
        (1, 0, "assistant", call("a", "search", {"limit": "x", "more": 1})),
        (1, 1, "assistant", call("a", "search", {"query": "again"})),
        (1, 2, "tool", result("a", 1)),
        (1, 3, "tool", result("z", 1)),
        (1, 4, "assistant", "<tool_call>{bad</tool_call>"),
        (1, 5, "assistant", call("n", "nothing", {})),
        (1, 6, "tool", "no json"),
        (1, 7, "tool", result("a", 2)),
    ]
    out = {r["turn"]: r["problems"] for r in run(spark, rows)}
    assert out[0] == "a:missing:query,a:type:limit,a:unexpected:more"
    assert out[1] == "a:duplicate" and out[2] == "" and out[3] == "result:orphan"
    assert "malformed" in out[4] and out[5] == "n:unanswered,n:unknown tool"
    assert out[6] == "result:malformed" and out[7] == "result:duplicate"


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(None, None, None, None, "x"), (1, None, "tool", result("a", 1), "x"), (1, 0, "assistant", call("a", "search", {"query": "x"}), "x"), (1, 0, "assistant", call("a", "search", {"query": "x"}), "y"), (None, 1, "tool", result("a", 1), "z")]
    out = run(spark, rows, FIELDS + ", digest string")
    assert len(out) == 5
    assert sorted(r["n_linked"] for r in out) == [0, 0, 1, 1, 1]


def test_nested_schemas(spark):
    schema = {
        "type": "object",
        "required": ["where"],
        "properties": {
            "where": {"type": "object", "required": ["city"], "additionalProperties": False, "properties": {"city": {"type": "string", "minLength": 2, "pattern": "^[A-Z]"}, "floor": {"type": "integer", "minimum": 0, "maximum": 9}}},
            "tags": {"type": "array", "maxItems": 3, "items": {"type": "object", "properties": {"k": {"enum": ["a", 1, None]}}}},
            "when": {"type": ["string", "null"]},
            "odd": {"anyOf": [{"type": "string"}]},
        },
    }
    tools = json.dumps([{"name": "book", "schema": json.dumps(schema)}, {"name": "book", "schema": "{}"}])
    cases = [
        ({"where": {"city": "Rome", "floor": 3}, "tags": [{"k": "a"}, {"k": 1}, {"k": None}], "when": None}, ""),
        ({"where": {"city": "r", "floor": 12, "street": 1}}, "length:where.city,pattern:where.city,range:where.floor,unexpected:where.street"),
        ({"where": {"floor": 1.5}}, "missing:where.city,type:where.floor"),
        ({"where": [], "tags": {}}, "type:tags,type:where"),
        ({"where": {"city": "Rome"}, "tags": [{"k": "b"}, 7, {}, {}]}, "enum:tags[0].k,length:tags,type:tags[1]"),
        ({"odd": 1}, "missing:where,unsupported:odd:anyOf"),
        ({}, "missing:where"),
    ]
    rows = [row for i, (arguments, _) in enumerate(cases) for row in ((1, 2 * i, "assistant", call(f"c{i}", "book", arguments)), (1, 2 * i + 1, "tool", result(f"c{i}", 1)))]
    out = {r["turn"]: r["problems"] for r in run(spark, rows, tools=tools)}
    for i, (_, want) in enumerate(cases):
        assert out[2 * i] == ",".join(f"c{i}:{p}" for p in want.split(",") if p), i
    assert {r["turn"]: r["problems"] for r in run(spark, rows[:1], tools="[]")} == {0: "c0:unanswered,c0:unknown tool"}


def test_long_chains_in_order_take_no_rounds(spark):
    n = 300
    rows = [row for i in range(n) for row in ((1, 2 * i, "assistant", call(f"c{i}", "search", {"query": "x"}, [f"c{i - 1}"] if i else None)), (1, 2 * i + 1, "tool", result(f"c{i}", 1)))]
    rows += [(2, 0, "tool", result("a", 1)), (2, 1, "assistant", call("a", "search", {"query": "x"}))]
    out = run(spark, rows)
    assert [r["turn"] for r in out] == [*range(2 * n), 1, 0] and all(r["n_linked"] == 1 and not r["cyclic"] for r in out)


def test_tool_calls_against_sql(spark):
    d = "/root/testdata/sf0.01"
    out = chat.chat_tool_calls(spark, d)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({chat.TOOL_ORACLE})").fetchall()
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(want) and sum(r[6] for r in got) > 100 and any(r[4] for r in got)


def test_empty(spark):
    assert run(spark, []) == []


def test_oracle(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in chat.op6_chat_formatting(spark, d).select("conv_id", "turn", "message", "place_turn").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    assert got == sorted(con.execute(f"SELECT conv_id, turn, message, place_turn FROM ({chat.ORACLE})").fetchall())


def test_native(spark):
    for f in (chat.op6_chat_formatting, chat.chat_tool_calls):
        plan = f(spark, "/root/testdata/sf0.001").select(F.count("*"))._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
