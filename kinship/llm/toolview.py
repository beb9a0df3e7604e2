"""Conversations with tool calls, made of the conversations table, which has none: every assistant message calls one or two tools, in
ways right and wrong, and rows of role tool bring results. What is called depends on the numbers of conversation and turn alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The first call of an assistant message by (conv_id + turn) modulo 6: (tool, arguments); {turn} and {before} stand for the turn's
#: number and that of two turns before.
FIRST = [
    ("search", '{{"limit":{turn},"query":"q{turn}"}}'),
    ("calculate", '{{"expression":"$a{before}"}}'),
    ("open_page", '{{"url":{turn}}}'),
    ("get_weather", '{{"days":true,"place":"p{turn}"}}'),
    ("teleport", '{{"to":"t{turn}"}}'),
    ("search", "no object"),
]
#: The second call, in every third conversation, refers to the first.
SECOND = ("run_code", '{{"code":"$a{turn}","timeout":1.5}}')


def _filled(pattern: str):
    """A pattern as a column of conv_id and turn."""
    text = pattern.replace("{{", "{").replace("}}", "}")
    out = F.replace(F.lit(text), F.lit("{turn}"), F.col("turn").cast("string"))
    return F.replace(out, F.lit("{before}"), (F.col("turn") - 2).cast("string"))


def _filled_sql(pattern: str) -> str:
    text = pattern.replace("{{", "{").replace("}}", "}").replace("'", "''")
    return f"replace(replace('{text}', '{{turn}}', CAST(turn AS VARCHAR)), '{{before}}', CAST(turn - 2 AS VARCHAR))"


def with_calls(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): assistant texts as JSON with tool_calls, and results as rows of role tool in the same turn. In every
    seventh conversation the second call has the first one's id; every fifth has no results, and every eleventh has them twice."""
    c = conversations.select("conv_id", "turn", "role", "text")
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(FIRST)))
    name = args = None
    for i, (tool, pattern) in enumerate(FIRST):
        name = F.when(kind == i, tool) if name is None else name.when(kind == i, tool)
        args = F.when(kind == i, _filled(pattern)) if args is None else args.when(kind == i, _filled(pattern))
    turn = F.col("turn").cast("string")
    call = lambda id_, tool, arguments: F.struct(id_.alias("id"), tool.alias("name"), arguments.alias("arguments"))
    one = call(F.concat(F.lit("a"), turn), name, args)
    two = call(F.concat(F.when(F.col("conv_id") % 7 == 3, "a").otherwise("b"), turn), F.lit(SECOND[0]), _filled(SECOND[1]))
    calls = F.when(F.col("conv_id") % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    asked = F.col("role") == "assistant"
    text = F.when(asked, F.to_json(F.struct(F.col("text").alias("content"), calls.alias("tool_calls")))).otherwise(F.col("text"))
    out = c.select("conv_id", "turn", "role", text.alias("text"))
    contents = F.when(F.col("conv_id") % 11 == 5, F.array(F.lit("first"), F.lit("again"))).otherwise(F.array(F.lit("only")))
    results = c.where(asked & (F.col("conv_id") % 5 != 4)).select("conv_id", "turn", F.explode(contents).alias("content"))
    result = F.to_json(F.struct(F.concat(F.lit("a"), turn).alias("tool_call_id"), F.concat("content", F.lit(" "), turn).alias("content")))
    return out.unionByName(results.select("conv_id", "turn", F.lit("tool").alias("role"), result.alias("text")))


def oracle() -> str:
    """DuckDB SQL for the formatted view: links, checks and levels worked out from the calls and results as tables."""
    from .chat import TOOLS

    first_name = " ".join(f"WHEN {i} THEN '{tool}'" for i, (tool, _) in enumerate(FIRST))
    first_args = " ".join(f"WHEN {i} THEN {_filled_sql(p)}" for i, (_, p) in enumerate(FIRST))
    tools = ", ".join(f"('{name}', '{a}', '{kind}', {a in t['required']})" for name, t in TOOLS.items() for a, kind in t["properties"].items())
    return f"""
WITH RECURSIVE said AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'assistant' OR role IS NULL),
asks AS (SELECT conv_id, turn, role, text FROM conversations WHERE role = 'assistant'),
calls AS (
  SELECT conv_id, turn, 0 AS n, 'a' || turn AS id, CASE (conv_id + turn) % {len(FIRST)} {first_name} END AS name,
         CASE (conv_id + turn) % {len(FIRST)} {first_args} END AS raw FROM asks
  UNION ALL
  SELECT conv_id, turn, 1, CASE WHEN conv_id % 7 = 3 THEN 'a' ELSE 'b' END || turn, '{SECOND[0]}', {_filled_sql(SECOND[1])}
  FROM asks WHERE conv_id % 3 = 0),
results AS (
  SELECT conv_id, turn, 'a' || turn AS id, unnest(CASE WHEN conv_id % 11 = 5 THEN ['first', 'again'] ELSE ['only'] END) || ' ' || turn AS content
  FROM asks WHERE conv_id % 5 <> 4),
tools(name, arg, kind, required) AS (VALUES {tools}),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, n) = 1 AS own, json_valid(raw) AS good FROM calls),
answer AS (SELECT conv_id, id, min(turn) AS result_turn, min(content) AS result FROM results GROUP BY ALL),
args AS (
  SELECT conv_id, turn, n, name, unnest(json_keys(raw)) AS arg, raw FROM own WHERE good),
typed AS (
  SELECT *, json_type(raw, '$.' || arg) AS found, json_extract_string(raw, '$.' || arg) AS value FROM args),
refers AS (SELECT DISTINCT conv_id, turn, n, substr(value, 2) AS id FROM typed WHERE found = 'VARCHAR' AND value LIKE '$_%'),
target AS (
  SELECT r.*, o.turn AS to_turn, o.n AS to_n FROM refers r LEFT JOIN own o ON o.own AND o.conv_id = r.conv_id AND o.id = r.id),
errors AS (
  SELECT conv_id, turn, n, 'duplicate_id' AS error FROM own WHERE NOT own
  UNION ALL SELECT o.conv_id, o.turn, o.n, 'no_result' FROM own o LEFT JOIN answer a ON a.conv_id = o.conv_id AND a.id = o.id WHERE a.id IS NULL OR NOT o.own
  UNION ALL SELECT conv_id, turn, n, 'unknown_tool' FROM own WHERE name NOT IN (SELECT name FROM tools)
  UNION ALL SELECT conv_id, turn, n, 'bad_arguments' FROM own WHERE name IN (SELECT name FROM tools) AND NOT good
  UNION ALL SELECT o.conv_id, o.turn, o.n, 'missing:' || t.arg FROM own o JOIN tools t ON t.name = o.name
            WHERE o.good AND t.required AND NOT list_contains(json_keys(o.raw), t.arg)
  UNION ALL SELECT a.conv_id, a.turn, a.n, 'unexpected:' || a.arg FROM typed a
            WHERE a.name IN (SELECT name FROM tools) AND NOT EXISTS (SELECT 1 FROM tools t WHERE t.name = a.name AND t.arg = a.arg)
  UNION ALL SELECT a.conv_id, a.turn, a.n, 'type:' || a.arg FROM typed a JOIN tools t ON t.name = a.name AND t.arg = a.arg
            WHERE NOT (a.found = 'VARCHAR' AND a.value LIKE '$_%') AND NOT CASE t.kind
              WHEN 'integer' THEN a.found IN ('BIGINT', 'UBIGINT') WHEN 'string' THEN a.found = 'VARCHAR' WHEN 'boolean' THEN a.found = 'BOOLEAN'
              WHEN 'number' THEN a.found IN ('BIGINT', 'UBIGINT', 'DOUBLE') WHEN 'object' THEN a.found = 'OBJECT' WHEN 'array' THEN a.found = 'ARRAY' END
  UNION ALL SELECT conv_id, turn, n, 'unresolved:' || id FROM target WHERE to_turn IS NULL),
level AS (
  SELECT conv_id, turn, n, 0 AS level FROM own o
  WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.conv_id = o.conv_id AND t.turn = o.turn AND t.n = o.n AND t.to_turn IS NOT NULL)
  UNION ALL
  SELECT t.conv_id, t.turn, t.n, l.level + 1 FROM level l JOIN target t ON t.conv_id = l.conv_id AND t.to_turn = l.turn AND t.to_n = l.n),
each AS (
  SELECT o.conv_id, o.turn, o.n, l.level, CASE WHEN o.own THEN a.result_turn END AS result_turn,
         (SELECT count(*) FROM errors e WHERE e.conv_id = o.conv_id AND e.turn = o.turn AND e.n = o.n) AS n_errors,
         '{{' || concat_ws(',', '"arguments":' || to_json(o.raw)::VARCHAR,
           '"errors":' || to_json(coalesce((SELECT list(error ORDER BY error) FROM errors e WHERE e.conv_id = o.conv_id AND e.turn = o.turn AND e.n = o.n), []))::VARCHAR,
           '"id":' || to_json(o.id)::VARCHAR, '"level":' || l.level, '"name":' || to_json(o.name)::VARCHAR,
           CASE WHEN o.own THEN '"result":' || to_json(a.result)::VARCHAR END, CASE WHEN o.own THEN '"result_turn":' || a.result_turn END) || '}}' AS call
  FROM own o JOIN level l USING (conv_id, turn, n) LEFT JOIN answer a ON a.conv_id = o.conv_id AND a.id = o.id),
per AS (
  SELECT conv_id, turn, max(level) AS level, count(*) AS n_calls, count(result_turn) AS n_linked, sum(n_errors) AS n_errors,
         string_agg(call, ',' ORDER BY level, n) AS calls FROM each GROUP BY ALL)
SELECT conv_id, turn, role, 0 AS level, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_errors,
       '{{' || concat_ws(',', '"content":' || to_json(text)::VARCHAR, '"role":' || to_json(role)::VARCHAR) || '}}' AS message FROM said
UNION ALL
SELECT conv_id, turn, 'tool', 0, 0, 0, 0, '{{"content":' || to_json(content)::VARCHAR || ',"role":"tool","tool_call_id":' || to_json(id)::VARCHAR || '}}' FROM results
UNION ALL
SELECT a.conv_id, a.turn, a.role, p.level, CAST(n_calls AS BIGINT), CAST(n_linked AS BIGINT), CAST(n_errors AS BIGINT),
       '{{' || concat_ws(',', '"content":' || to_json(a.text)::VARCHAR, '"role":"assistant"', '"tool_calls":[' || p.calls || ']') || '}}'
FROM asks a JOIN per p USING (conv_id, turn)
"""
