"""op5_chat checks the arguments of calls."""

import json

from kinship.llm import queries as q
from kinship.llm.chat import TOOLS, formatted, linked_calls


def test_tools_check_arguments(spark):
    call = lambda i, name, args: (i, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": name, "arguments": args}]}))
    calls = [
        call(1, "search", {"query": "x", "limit": 3}),
        call(2, "search", {"limit": "3", "more": 1}),
        call(3, "write_file", "no object"),
        call(4, "no_such_tool", {}),
    ]
    rows = calls + [(i, 1, "tool", json.dumps({"tool_call_id": "a", "content": "r"})) for i in range(1, 5)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in formatted(messages, TOOLS).where("role = 'assistant'").collect()}
    errors = {i: json.loads(r["message"])["tool_calls"][0]["errors"] for i, r in got.items()}
    assert errors == {1: [], 2: ["missing:query", "type:limit", "unexpected:more"], 3: ["bad_arguments"], 4: ["unknown_tool"]}
    assert {i: (r["n_calls"], r["n_linked"], r["n_errors"]) for i, r in got.items()} == {1: (1, 1, 0), 2: (1, 1, 3), 3: (1, 1, 1), 4: (1, 1, 1)}


def test_query_links_checks_and_orders(spark):
    rows = q.op5_chat(spark, "/root/testdata/sf0.001").where("role = 'assistant'").collect()
    calls = [c for r in rows for c in json.loads(r["message"])["tool_calls"]]
    kinds = {e.split(":")[0] for c in calls for e in c["errors"]}
    assert kinds == {"bad_arguments", "duplicate_id", "missing", "no_result", "type", "unexpected", "unknown_tool", "unresolved"}
    assert {c["level"] for c in calls} >= {0, 1, 2} and sum(r["n_linked"] for r in rows) > 0 < sum(not c["errors"] for c in calls)


def test_rows_without_conversation_are_one(spark):
    say = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": "search", "arguments": {"query": a}} for i, a in calls]})
    rows = [(None, 0, "assistant", say(("a", "x"))), (None, 1, "tool", json.dumps({"tool_call_id": "a", "content": "r"})), (None, 2, "assistant", say(("a", "y"), ("b", "$a")))]
    got = {(r["id"], r["turn"]): (r["errors"], r["level"], r["result"]) for r in linked_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()}
    assert got == {("a", 0): ([], 0, "r"), ("a", 2): (["duplicate_id", "no_result"], 0, None), ("b", 2): (["no_result"], 1, None)}
