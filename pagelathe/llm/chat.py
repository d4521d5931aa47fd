"""Chat formatting: tool calls and their results, linked, ordered, validated and written as canonical JSON.

A message may hold calls, `<tool_call>{"id": …, "name": …, "arguments": {…}, "after": [ids]}</tool_call>`; a message
of the role `tool` is one result, `{"tool_call_id": …, "content": …}`. Calls and results are joined by hash on
(conv_id, identifier), after both were reduced to one row for each identifier: the first call and the first result
count, further ones are flagged. A result comes after its call, and a call after the results of the identifiers in its
`after`. Messages get their place by peeling: each round places those all of whose predecessors have a place, at the
greatest of their own turn and their predecessors' places. Ordering by (place_turn, place_depth, turn) is a
topological order that moves only what stands too early. What no round can place is in or behind a cycle, keeps its
turn and is flagged. Arguments are validated against JSON schemas, to the depth that the catalogue of tools has: type,
enum, const, required, properties, additionalProperties (false), items, minimum and maximum, lengths and pattern; any
other keyword of a schema that applies is a problem of its own. Canonical JSON has sorted keys and no white space. All is built from SQL
functions, and nothing is gathered by conversation.

Defined results. A message row gives one row. Null texts are empty, a null role is absent from the JSON. Rows that
repeat conv_id, turn, role and text each appear, with equal results, and count as one message; rows that share conv_id
and turn share a place. A call without id or of malformed JSON is `malformed` and never linked; rows whose conv_id is
null are formatted but not linked. A message without a turn keeps none. Canonical JSON leaves out null fields outside
`arguments`. Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: The catalogue of tools that op6 validates against (name, JSON schema of the arguments).
TOOLS = """[
 {"name": "search", "schema": "{\\"type\\":\\"object\\",\\"properties\\":{\\"query\\":{\\"type\\":\\"string\\"},\\"limit\\":{\\"type\\":\\"integer\\"}},\\"required\\":[\\"query\\"],\\"additionalProperties\\":false}"},
 {"name": "calculate", "schema": "{\\"type\\":\\"object\\",\\"properties\\":{\\"expression\\":{\\"type\\":\\"string\\"}},\\"required\\":[\\"expression\\"]}"}
]"""
CALL = r"(?s)<tool_call>(.*?)</tool_call>"
CALL_FIELDS = "array<struct<id:string,name:string,arguments:variant,after:array<string>>>"
#: A schema node: of a tool, the object or array at `path` (`$`, `.name` for properties, `[]` for what an array holds).
NODE = "array<struct<name:string,path:string,types:array<string>,enum:array<string>,required:array<string>,known:array<string>,closed:boolean,least:double,most:double,shortest:int,longest:int,pattern:string,unsupported:array<string>>>"
UNDERSTOOD = frozenset("type enum const required properties additionalProperties items minimum maximum minLength maxLength minItems maxItems pattern title description default examples $schema $id".split())


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def schema_nodes(name: str, schema: dict, path: str = "$") -> list[dict]:
    """The nodes of a JSON schema, to its own depth."""
    kind, known = schema.get("type"), schema.get("properties") or {}
    enum = schema["enum"] if "enum" in schema else [schema["const"]] if "const" in schema else None
    more, items = schema.get("additionalProperties", True), schema.get("items")
    odd = sorted(schema.keys() - UNDERSTOOD) + (["additionalProperties"] if isinstance(more, dict) else []) + (["items"] if isinstance(items, list) else [])
    out = [
        {
            "name": name, "path": path, "types": [kind] if isinstance(kind, str) else kind, "enum": None if enum is None else [canonical(x) for x in enum],
            "required": schema.get("required"), "known": sorted(known), "closed": more is False, "least": schema.get("minimum"), "most": schema.get("maximum"),
            "shortest": schema.get("minLength", schema.get("minItems")), "longest": schema.get("maxLength", schema.get("maxItems")), "pattern": schema.get("pattern"), "unsupported": odd,
        }
    ]
    for k, sub in known.items():
        out += schema_nodes(name, sub, f"{path}.{k}") if isinstance(sub, dict) else []
    return out + (schema_nodes(name, items, f"{path}[]") if isinstance(items, dict) else [])


def catalogue(spark: SparkSession, tools: str = TOOLS) -> tuple[DataFrame, int]:
    """(rows of schema nodes, levels below the top) of a JSON text of tools (name, schema); of equal names the first counts."""
    rows, names = [], set()
    for tool in json.loads(tools):
        if tool["name"] not in names:
            names.add(tool["name"])
            rows += schema_nodes(tool["name"], json.loads(tool["schema"]))
    nodes = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), NODE)))
    return nodes, max((r["path"].count(".") + r["path"].count("[]") for r in rows), default=0)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, calls (CALL_FIELDS, null for malformed ones), result (id and content)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"))

    def call(body: Column) -> Column:
        v = F.try_parse_json(body)
        get = lambda path, kind: F.try_variant_get(v, F.lit(path), kind)
        return F.struct(get("$.id", "string").alias("id"), get("$.name", "string").alias("name"), get("$.arguments", "variant").alias("arguments"), get("$.after", "array<string>").alias("after"))

    calls = F.when(F.col("text").contains("<tool_call>"), F.transform(F.regexp_extract_all("text", F.lit(CALL), F.lit(1)), call)).otherwise(F.array().cast(CALL_FIELDS))
    v = F.try_parse_json("text")
    result = F.when(F.col("role") == "tool", F.struct(F.try_variant_get(v, F.lit("$.tool_call_id"), "string").alias("id"), F.try_variant_get(v, F.lit("$.content"), "variant").alias("content")))
    return rows.select("*", calls.alias("calls"), result.alias("result"))


def fits(value: Column, kind: Column) -> Column:
    """Whether a variant is of a JSON schema type."""
    own = F.schema_of_variant(value)
    whole = F.to_json(value).rlike(r"^-?[0-9]+([.]0+)?$")
    number = own.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return (
        F.when(kind == "integer", number & whole)
        .when(kind == "number", number)
        .when(kind == "string", own == "STRING")
        .when(kind == "boolean", own == "BOOLEAN")
        .when(kind == "null", own == "VOID")
        .when(kind == "object", own.startswith("OBJECT"))
        .when(kind == "array", own.startswith("ARRAY"))
        .otherwise(F.lit(True))
    )


def problems(calls: DataFrame, key: list[str], tools: DataFrame, levels: int) -> DataFrame:
    """(key, problems): what is wrong with the arguments of calls (key, name, arguments): array<string>.

    Arguments become rows, a level at a time down to the catalogue's own depth, and are joined with the schema nodes of
    their tool and path.
    """
    nothing = F.array().cast("array<string>")
    one = "struct<part:string,general:string,value:variant>"
    own = lambda v: F.from_json(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v)), "map<string,variant>")

    def inside(v: Column) -> Column:
        fields = F.transform(F.map_entries(own(v)), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("part"), F.concat(F.lit("."), e["key"]).alias("general"), e["value"].alias("value")))
        items = F.transform(F.try_variant_get(v, F.lit("$"), "array<variant>"), lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("part"), F.lit("[]").alias("general"), x.alias("value")))
        return F.coalesce(fields.cast(f"array<{one}>"), items.cast(f"array<{one}>"))

    level = calls.where("arguments is not null").select(*key, "name", F.lit("").alias("at"), F.lit("$").alias("path"), F.col("arguments").alias("value"))
    every = level
    for _ in range(levels):
        level = level.select(*key, "name", "at", "path", F.explode(inside(F.col("value"))).alias("x")).select(*key, "name", F.concat("at", "x.part").alias("at"), F.concat("path", "x.general").alias("path"), F.col("x.value").alias("value"))
        every = every.union(level)
    names = F.coalesce(F.map_keys(own(F.col("value"))), nothing)
    is_object = F.schema_of_variant("value").startswith("OBJECT")
    text, list_of = F.try_variant_get("value", F.lit("$"), "string"), F.try_variant_get("value", F.lit("$"), "array<variant>")
    is_text = F.schema_of_variant("value") == "STRING"
    number = F.when(fits(F.col("value"), F.lit("number")), F.try_variant_get("value", F.lit("$"), "double"))
    size = F.when(is_text, F.char_length(text)).otherwise(F.size(list_of))
    at = F.regexp_replace("at", "^[.]", "")
    below = lambda n: F.when(at == "", n).otherwise(F.concat(at, F.lit("."), n))
    said = lambda what, wrong: F.when(F.coalesce(wrong, F.lit(False)), F.array(F.concat(F.lit(what), at))).otherwise(nothing)
    named = lambda what, some: F.transform(some, lambda n: F.concat(F.lit(what), below(n)))
    found = F.concat(
        F.when(is_object, named("missing:", F.array_except(F.coalesce("required", nothing), names))).otherwise(nothing),
        F.when(F.col("closed"), named("unexpected:", F.array_except(names, "known"))).otherwise(nothing),
        said("type:", F.col("types").isNotNull() & ~F.exists("types", lambda k: fits(F.col("value"), k))),
        said("enum:", F.col("enum").isNotNull() & ~F.array_contains("enum", F.to_json("value"))),
        said("range:", (number < F.col("least")) | (number > F.col("most"))),
        said("length:", (size < F.col("shortest")) | (size > F.col("longest"))),
        said("pattern:", is_text & F.col("pattern").isNotNull() & ~F.regexp_like(text, F.col("pattern"))),
        F.transform("unsupported", lambda k: F.concat(F.lit("unsupported:"), F.when(at == "", k).otherwise(F.concat(at, F.lit(":"), k)))),
    )
    # bounded by the catalogue, whose rows stand in the plan
    known = every.join(F.broadcast(tools), ["name", "path"]).select(*key, found.alias("found")).where(F.size("found") > 0)
    return known.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("problems"))  # of one call


def placed(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, place_turn, place_depth, cyclic) of the turns in edges (conv_id, before, turn), peeled round by round.

    Where all edges of a conversation lead to later turns each message is in its place, however long its chains: such
    conversations have no rows. Rounds are as many as the longest chain of a conversation that has an edge to an earlier turn.
    """
    edges = scratch.keep(edges.join(edges.where("before > turn").select("conv_id").distinct(), "conv_id", "left_semi"), "backward")
    first = edges.select("conv_id", F.col("before").alias("turn")).distinct().join(edges, ["conv_id", "turn"], "left_anti")
    done = scratch.keep(first.select("conv_id", "turn", F.struct(F.col("turn").alias("at"), F.lit(0).alias("depth")).alias("place")), "places0")
    waiting, turn = edges, 0
    while not waiting.isEmpty():
        turn += 1
        reach = waiting.join(done.select("conv_id", F.col("turn").alias("before"), "place"), ["conv_id", "before"], "left")
        state = reach.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.count("place").alias("ready"), F.max(F.struct(F.col("place.at").alias("at"), (F.col("place.depth") + 1).alias("depth"))).alias("after"))
        fresh = state.where("n = ready").select("conv_id", "turn", F.greatest(F.struct(F.col("turn").alias("at"), F.lit(0).alias("depth")), F.col("after")).alias("place"))
        fresh = scratch.keep(fresh, f"fresh{turn}")
        if fresh.isEmpty():
            break
        done = done.union(fresh)
        waiting = scratch.keep(waiting.join(fresh.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti"), f"waiting{turn}")
    stuck = waiting.select("conv_id", "turn").distinct().select("conv_id", "turn", F.struct(F.col("turn").alias("at"), F.lit(0).alias("depth")).alias("place"), F.lit(True).alias("cyclic"))
    return done.withColumn("cyclic", F.lit(False)).union(stuck).select("conv_id", "turn", F.col("place.at").alias("place_turn"), F.col("place.depth").alias("place_depth"), "cyclic")


def formatted(messages: DataFrame, tools: str = TOOLS) -> DataFrame:
    """One row for each message: conv_id, turn, role, place_turn, place_depth, cyclic, n_calls, n_linked, problems, message."""
    spark = messages.sparkSession
    scratch = Scratch(spark, "chat")
    rows = parsed(messages)
    uses = (F.size("calls") > 0) | F.col("result").isNotNull()
    key = ["conv_id", "turn", "role", "digest"]
    with_tools = scratch.keep(rows.where(uses).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)), "with_tools")
    once = with_tools.dropDuplicates(key)
    calls = scratch.keep(once.select(*key, F.posexplode("calls").alias("no", "call")).select(*key, "no", "call.*"), "calls")
    results = scratch.keep(once.where("result is not null").select(*key, F.col("result.id").alias("id")), "results")

    order = F.struct("turn", "no", "digest")
    linkable = "conv_id is not null and id is not null"
    first_call = calls.where(linkable).groupBy("conv_id", "id").agg(F.min(order).alias("call_at"))
    first_result = results.where(linkable).groupBy("conv_id", "id").agg(F.min(F.struct("turn", "digest")).alias("result_at"))
    links = scratch.keep(first_call.join(first_result, ["conv_id", "id"], "full"), "links")

    pairs = links.select("conv_id", F.col("call_at.turn").alias("before"), F.col("result_at.turn").alias("turn"))
    after = calls.where("conv_id is not null").select("conv_id", "turn", F.explode(F.array_distinct("after")).alias("id"))
    waits = after.join(links.where("result_at is not null").select("conv_id", "id", F.col("result_at.turn").alias("before")), ["conv_id", "id"]).select("conv_id", "before", "turn")
    edges = scratch.keep(pairs.union(waits).where("before is not null and turn is not null and before <> turn").distinct(), "edges")
    places = scratch.keep(placed(edges, scratch), "places")

    nodes, levels = catalogue(spark, tools)
    mine = [*key, "no"]
    wrong = scratch.keep(problems(calls, mine, nodes, levels), "wrong").withColumnsRenamed({k: f"_{k}" for k in mine})
    tool = nodes.where("path = '$'").select("name", F.lit(True).alias("is_known"))
    state = F.when(F.col("id").isNull() | F.col("arguments").isNull(), "malformed").when(F.col("conv_id").isNull() | F.col("result_at").isNull(), "unanswered").when(order != F.col("call_at"), "duplicate").otherwise("linked")
    judged = calls.join(links, ["conv_id", "id"], "left").join(F.broadcast(tool), "name", "left").withColumn("state", state)
    judged = judged.join(wrong, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in mine], "left")
    found = F.when(F.col("is_known").isNull(), F.array(F.lit("unknown tool"))).when(~F.schema_of_variant("arguments").startswith("OBJECT") | F.col("arguments").isNull(), F.array(F.lit("malformed"))).otherwise(F.coalesce("problems", F.array().cast("array<string>")))
    judged = judged.withColumn("problems", found)
    label = F.coalesce("id", F.lit(""))
    per_call = judged.groupBy(*key).agg(
        F.count_if(F.col("state") == "linked").alias("linked_calls"),
        F.array_sort(F.flatten(F.collect_list(F.transform(F.concat(F.when(F.col("state") != "linked", F.array("state")).otherwise(F.array().cast("array<string>")), "problems"), lambda p: F.concat_ws(":", label, p))))).alias("call_problems"),
    )
    own = F.when(F.col("id").isNull(), "malformed").when(F.col("conv_id").isNull() | F.col("call_at").isNull(), "orphan").when(F.struct("turn", "digest") != F.col("result_at"), "duplicate").otherwise("linked")
    per_result = results.join(links, ["conv_id", "id"], "left").select(*key, own.alias("result_state"))

    def on(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({k: f"_{k}" for k in key})
        return left.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left").drop(*[f"_{k}" for k in key])

    facts = on(on(once.select(*key), per_call), per_result)
    nothing = F.array().cast("array<string>")
    known = [
        F.coalesce("linked_calls", F.lit(0)).alias("linked_calls"),
        F.concat(F.coalesce("call_problems", nothing), F.when(F.col("result_state") != "linked", F.array(F.concat(F.lit("result:"), F.col("result_state")))).otherwise(nothing)).alias("problems"),
        (F.coalesce(F.col("result_state") == "linked", F.lit(False))).cast("int").alias("linked_result"),
    ]
    facts = scratch.keep(facts.select(*key, *known), "facts")
    tooled = on(with_tools, facts).join(places, ["conv_id", "turn"], "left")

    canonical = F.to_json(
        F.struct(
            F.when(F.size("calls") > 0, F.transform("calls", lambda c: F.struct(c["after"].alias("after"), c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))).alias("calls"),
            F.when(F.col("result").isNull(), F.trim(F.regexp_replace("text", CALL, ""))).alias("content"),
            F.col("result.content").alias("result"),
            F.col("role"),
            F.col("result.id").alias("tool_call_id"),
        )
    )
    shown = ["conv_id", "turn", "role"]
    with_all = tooled.select(*shown, F.coalesce("place_turn", "turn").alias("place_turn"), F.coalesce("place_depth", F.lit(0)).alias("place_depth"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.size("calls").cast("long").alias("n_calls"), (F.coalesce("linked_calls", F.lit(0)) + F.coalesce("linked_result", F.lit(0))).cast("long").alias("n_linked"), F.array_join("problems", ",").alias("problems"), canonical.alias("message"))
    plain = rows.where(~uses).select(*shown, F.col("turn").alias("place_turn"), F.lit(0).alias("place_depth"), F.lit(False).alias("cyclic"), F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_linked"), F.lit("").alias("problems"), F.to_json(F.struct(F.col("text").alias("content"), F.col("role"))).alias("message"))
    return plain.union(with_all)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatted messages of `conversations`."""
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: For conversations without tool calls.
ORACLE = """
SELECT conv_id, turn, role, turn AS place_turn, 0::INT AS place_depth, false AS cyclic, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, '' AS problems,
       CASE WHEN role IS NULL THEN json_object('content', coalesce(text, ''))::VARCHAR
            ELSE json_object('content', coalesce(text, ''), 'role', role)::VARCHAR END AS message
FROM conversations
"""


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of `conversations` as tool calls and results, for SQL to follow: results stand before their calls, arguments are wrong now and then."""
    t = F.col("turn").cast("string")
    call = F.concat(F.lit('ok <tool_call>{"name":"search","id":"c'), t, F.lit('","arguments":{"query":"q'), t, F.when(F.col("turn") % 4 == 1, F.lit('","limit":"x')).when(F.col("turn") % 4 == 3, F.lit('","depth":"y')).otherwise(F.lit("")), F.lit('"}}</tool_call>'))
    result = F.concat(F.lit('{"tool_call_id":"c'), (F.col("turn") + 1).cast("string"), F.lit('","content":"r"}'))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.when(F.col("role") == "assistant", call).when(F.col("role") == "user", result).otherwise(F.lit("plain"))
    role = F.when(F.col("role") == "user", "tool").otherwise(F.col("role"))
    return formatted(rows.select("conv_id", "turn", role.alias("role"), text.alias("text")))


TOOL_ORACLE = """
WITH c AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'), r AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
m AS (SELECT x.conv_id, x.turn, x.role, c.turn IS NOT NULL AS called, r.turn IS NOT NULL AS answered FROM conversations x
      LEFT JOIN c ON c.conv_id = x.conv_id AND c.turn = x.turn + 1 AND x.role = 'user' LEFT JOIN r ON r.conv_id = x.conv_id AND r.turn = x.turn - 1 AND x.role = 'assistant')
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'tool' ELSE role END AS role, turn + called::BIGINT AS place_turn, called::INT AS place_depth, false AS cyclic,
       (role = 'assistant')::BIGINT AS n_calls, (called OR answered)::BIGINT AS n_linked,
       CASE role WHEN 'assistant' THEN array_to_string(list_sort(list_filter([CASE WHEN NOT answered THEN 'c' || turn || ':unanswered' END,
              CASE turn % 4 WHEN 1 THEN 'c' || turn || ':type:limit' WHEN 3 THEN 'c' || turn || ':unexpected:depth' END], lambda x: x IS NOT NULL)), ',')
            WHEN 'user' THEN CASE WHEN called THEN '' ELSE 'result:orphan' END ELSE '' END AS problems,
       CASE role WHEN 'assistant' THEN '{"calls":[{"arguments":{' || CASE turn % 4 WHEN 1 THEN '"limit":"x",' WHEN 3 THEN '"depth":"y",' ELSE '' END || '"query":"q' || turn || '"},"id":"c' || turn || '","name":"search"}],"content":"ok","role":"assistant"}'
            WHEN 'user' THEN '{"result":"r","role":"tool","tool_call_id":"c' || (turn + 1) || '"}' ELSE '{"content":"plain","role":"' || role || '"}' END AS message
FROM m
"""
