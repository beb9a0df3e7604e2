"""Chat formatting: tool calls linked with their results, checked, ordered and written as canonical JSON, in DataFrame operations.

A message is a row (conv_id, turn, role, text). A text that is a JSON object with the array tool_calls, objects of id, name and
arguments, holds calls besides its content; one of role tool with tool_call_id holds the result of the call with that id in its
conversation. Any other text is content, also if it is broken JSON.

An argument that is the string "$x" refers to the result of call x. A call comes after the calls that it refers to, and a result
after its call: level 0 is a call that refers to none, a call's level is one more than the highest among those that it refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constant, row_key, stored

ENVELOPE = "content string, tool_call_id string, tool_calls array<struct<id: string, name: string, arguments: string>>"
#: JSON types by the names that Spark gives a variant's.
TYPES = {"integer": "BIGINT", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "array": "ARRAY", "object": "OBJECT"}

#: The tools that op5_chat checks arguments against; calls of others are unknown_tool.
TOOLS = {
    "search": {"properties": {"query": "string", "limit": "integer", "filters": "object"}, "required": ["query"]},
    "open_page": {"properties": {"url": "string", "page": "integer"}, "required": ["url"]},
    "calculate": {"properties": {"expression": "string", "precision": "integer"}, "required": ["expression"]},
    "run_code": {"properties": {"code": "string", "language": "string", "timeout": "number"}, "required": ["code"]},
    "read_file": {"properties": {"path": "string", "start": "integer", "end": "integer"}, "required": ["path"]},
    "write_file": {"properties": {"path": "string", "content": "string", "append": "boolean"}, "required": ["path", "content"]},
    "get_weather": {"properties": {"location": "string", "days": "integer"}, "required": ["location"]},
    "send_message": {"properties": {"to": "array", "subject": "string", "body": "string"}, "required": ["to", "body"]},
}


def schemas(spark: SparkSession, tools: dict[str, dict]) -> DataFrame:
    """(name, args): tools as {name: {"properties": {argument: JSON type}, "required": [argument]}}."""
    rows = [(name, [(a, kind, a in t.get("required", ())) for a, kind in sorted(t.get("properties", {}).items())]) for name, t in tools.items()]
    return constant(spark, rows, "name string, args array<struct<arg: string, kind: string, required: boolean>>")


def _is(kind: Column, value: Column) -> Column:
    """Whether a variant has a JSON type; number takes whole numbers too, an unknown type anything."""
    found = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    want = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))[kind]
    return F.when(kind == "number", found.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")).when(want.isNull(), True).otherwise(found == want)


def _parsed(messages: DataFrame) -> DataFrame:
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    body = F.when(F.col("text").rlike(r"^\s*\{"), F.from_json("text", ENVELOPE))
    m = m.withColumn("body", body).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))).withColumn("key", row_key("conv_id", "turn", "role", "text"))
    calls = F.col("body.tool_calls").isNotNull()
    result = (F.col("role") == "tool") & F.col("body.tool_call_id").isNotNull()
    return m.withColumn("kind", F.when(F.coalesce(calls, F.lit(False)), "calls").when(F.coalesce(result, F.lit(False)), "result").otherwise("plain"))


def linked_calls(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """One row a tool call: conv_id, turn, n (its place in the message), key (the message's), id, name, arguments (canonical JSON, or
    the text where it is none), level, result_turn, result (content), errors (sorted array of strings).

    Errors: duplicate_id (an earlier call of the conversation has the id), no_result, cycle (it refers, directly or not, to itself;
    level is null then, as for calls behind a cycle), unresolved:x (it refers to a call that is not there), unknown_tool, bad_arguments
    (no JSON object), missing:x, unexpected:x and type:x of an argument. A result belongs to the first call with its id in its
    conversation; of several results the first counts. Calls without id have no result. Rows without conv_id are one conversation."""
    spark = messages.sparkSession
    m = _parsed(messages)
    c = m.where("kind = 'calls'").select("conv", "conv_id", "turn", "key", F.posexplode("body.tool_calls").alias("n", "c"))
    c = c.select("conv", "conv_id", "turn", "n", "key", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("raw"))
    c = stored(c, "calls")
    first = c.groupBy("conv", "id").agg(F.min(F.struct("turn", "n", "key")).alias("first"))
    r = m.where("kind = 'result'").groupBy("conv", F.col("body.tool_call_id").alias("id"))
    r = r.agg(F.min(F.struct("turn", F.coalesce("body.content", F.lit("")).alias("content"))).alias("r"))
    c = c.join(first, ["conv", "id"], "left").withColumn("own", F.coalesce(F.col("first") == F.struct("turn", "n", "key"), F.lit(False)))
    c = c.hint("shuffle_hash").join(r.hint("shuffle_hash"), ["conv", "id"], "left")
    c = c.withColumn("v", F.try_parse_json("raw")).withColumn("good", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    c = c.withColumn("args", F.when(F.col("good"), F.col("v").cast("map<string,variant>")))
    c = c.join(F.broadcast(schemas(spark, tools)).withColumnRenamed("args", "want"), "name", "left")  # as many rows as tools
    names = F.coalesce(F.map_keys("args"), F.array())
    strings = F.transform(F.coalesce(F.map_values("args"), F.array()), lambda v: F.try_variant_get(v, "$", "string"))
    refers = F.array_distinct(F.transform(F.filter(strings, lambda s: s.rlike(r"^\$.")), lambda s: F.substr(s, F.lit(2))))
    want = F.coalesce("want", F.array())
    missing = F.transform(F.filter(want, lambda w: w["required"] & ~F.array_contains(names, w["arg"])), lambda w: F.concat(F.lit("missing:"), w["arg"]))
    extra = F.transform(F.filter(names, lambda a: ~F.exists(want, lambda w: w["arg"] == a)), lambda a: F.concat(F.lit("unexpected:"), a))
    # What a call refers to takes the type of a result, which is not known here.
    kinds = F.filter(want, lambda w: F.array_contains(names, w["arg"]) & ~_is(w["kind"], F.col("args")[w["arg"]]) & ~F.coalesce(F.try_variant_get(F.col("args")[w["arg"]], "$", "string").rlike(r"^\$."), F.lit(False)))
    kinds = F.transform(kinds, lambda w: F.concat(F.lit("type:"), w["arg"]))
    one = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array())
    checked = F.when(F.col("want").isNull(), F.array(F.lit("unknown_tool"))).when(~F.col("good"), F.array(F.lit("bad_arguments"))).otherwise(F.concat(missing, extra, kinds))
    errors = F.concat(one(~F.col("own") & F.col("id").isNotNull(), "duplicate_id"), one(F.col("r").isNull() | ~F.col("own"), "no_result"), checked)
    c = c.select("conv", "conv_id", "turn", "n", "key", "id", "name", F.coalesce(F.to_json("v"), "raw").alias("arguments"), refers.alias("refers"), "own", F.when(F.col("own"), F.col("r.turn")).alias("result_turn"), F.when(F.col("own"), F.col("r.content")).alias("result"), errors.alias("errors"))
    c = stored(c, "linked")
    levels = _levels(c)
    out = c.join(levels, ["key", "n"], "left").withColumn("level", F.when(F.size("refers") == 0, 0).otherwise(F.col("level")))
    late = F.transform(F.coalesce("unresolved", F.array().cast("array<string>")), lambda x: F.concat(F.lit("unresolved:"), x))
    all_ = F.array_sort(F.concat("errors", late, one(F.col("level").isNull() & (F.size(late) == 0), "cycle")))
    return out.select("conv_id", "turn", "n", "key", "id", "name", "arguments", "level", "result_turn", "result", all_.alias("errors"))


def _levels(c: DataFrame) -> DataFrame:
    """(key, n, level, unresolved) of the calls that refer to others, by rounds: a call has its level once all that it refers to have
    theirs. Rounds are as many as the longest chain; what no round reaches stays null."""
    waits = c.where(F.size("refers") > 0).select("conv", "key", "n", F.explode("refers").alias("id"))
    target = c.where("own").select("conv", "id", F.col("key").alias("tk"), F.col("n").alias("tn"), (F.size("refers") == 0).alias("free"))
    waits = stored(waits.join(target, ["conv", "id"], "left"), "waits")
    open_ = waits.groupBy("key", "n").agg(F.array_sort(F.collect_set(F.when(F.col("tk").isNull(), F.col("id")))).alias("unresolved"))
    known = stored(open_.where(F.size("unresolved") > 0).select("key", "n", F.lit(0).alias("level")), "levels")  # they wait for none
    while True:
        at = known.select(F.col("key").alias("tk"), F.col("n").alias("tn"), F.col("level").alias("have"))
        seen = waits.join(at, ["tk", "tn"], "left").withColumn("have", F.when(F.col("free"), 0).otherwise(F.col("have")))
        done = seen.groupBy("key", "n").agg(F.count("*").alias("all"), F.count("have").alias("some"), F.max("have").alias("high")).where("`all` = some")
        new = stored(done.join(known, ["key", "n"], "left_anti").select("key", "n", (F.col("high") + 1).cast("int").alias("level")), "levels")
        if not new.take(1):
            return open_.join(known, ["key", "n"], "left").select("key", "n", "level", "unresolved")
        known = known.unionByName(new)


def formatted(messages: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """One row a message: conv_id, turn, role, level, n_calls, n_linked, n_errors, message (canonical JSON).

    Canonical JSON has sorted keys, no white space and no null fields. A message with calls has them in topological order, by level,
    then place, with level null last. level is the message's highest; conversations in order of (conv_id, turn, level) have every
    result after its call. Null texts have no content; roles are kept as they are; rows stand for themselves, and those that agree in
    all four columns are formatted alike. Other columns are not read."""
    calls = linked_calls(messages, tools or {})
    one = F.struct(F.col("level").isNull().alias("none"), "level", "n", F.struct("arguments", "errors", "id", "level", "name", "result", "result_turn").alias("c"))
    per = calls.dropDuplicates(["key", "n"]).groupBy("key").agg(
        F.array_sort(F.collect_list(one)).alias("calls"), F.max("level").alias("level"), F.count("*").alias("n_calls"), F.count("result_turn").alias("n_linked"), F.sum(F.size("errors")).alias("n_errors")
    )
    m = _parsed(messages)
    zero = F.lit(0).cast("long")
    plain = m.where("kind <> 'calls'").select(
        "conv_id", "turn", "role", F.lit(0).alias("level"), zero.alias("n_calls"), zero.alias("n_linked"), zero.alias("n_errors"),
        F.when(F.col("kind") == "result", F.to_json(F.struct(F.col("body.content").alias("content"), "role", F.col("body.tool_call_id").alias("tool_call_id"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("content"), "role"))).alias("message"),
    )
    with_calls = m.where("kind = 'calls'").join(per, "key", "left").select(
        "conv_id", "turn", "role", "level", F.coalesce("n_calls", zero).alias("n_calls"), F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("n_errors", zero).alias("n_errors"),
        F.to_json(F.struct(F.col("body.content").alias("content"), "role", F.coalesce(F.transform("calls", lambda x: x["c"]), F.array()).alias("tool_calls"))).alias("message"),
    )
    return plain.unionByName(with_calls)
