import json

from kinship.llm.chat import formatted, linked_calls

ROWS = "conv_id long, turn long, role string, text string, key int, level string"
TOOLS = {
    "find": {"properties": {"q": "string", "limit": "integer", "deep": "boolean", "score": "number", "tags": "array", "opt": "object"}, "required": ["q"]},
    "get": {"properties": {"id": "string", "x": "integer"}},
}


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content="r"):
    return json.dumps({"tool_call_id": i, "content": content})


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)


def linked(spark, rows):
    return {(r["conv_id"], r["id"], r["turn"], r["n"]): r for r in linked_calls(table(spark, rows), TOOLS).collect()}


def test_links_and_levels(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call(("c", "get", {"id": "$b", "x": 1}), ("b", "get", {"id": "$a"}), ("a", "find", {"q": "é", "limit": 3}), content="ok")),
        (1, 2, "tool", result("a", "first")),
        (1, 3, "tool", result("b")),
        (1, 4, "tool", result("c")),
        (1, 5, "tool", result("a", "second")),
        (2, 0, "tool", result("a", "other conversation")),
        (2, 1, "assistant", call(("z", "find", {"q": "x"}))),
    ]
    got = linked(spark, rows)
    assert {k[1]: r["level"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "z": 0}
    a = got[1, "a", 1, 2]
    assert (a["result"], a["result_turn"], a["errors"], a["arguments"]) == ("first", 2, [], '{"limit":3,"q":"é"}')
    assert got[1, "c", 1, 0]["errors"] == [] and got[2, "z", 1, 0]["errors"] == ["no_result"]
    f = {(r["conv_id"], r["turn"]): r for r in formatted(table(spark, rows), TOOLS).collect()}
    m = json.loads(f[1, 1]["message"])
    assert [c["id"] for c in m["tool_calls"]] == ["a", "b", "c"] and list(m) == sorted(m) and m["content"] == "ok"
    assert (f[1, 1]["n_calls"], f[1, 1]["n_linked"], f[1, 1]["n_errors"], f[1, 1]["level"]) == (3, 3, 0, 2)
    assert f[1, 0]["message"] == '{"content":"hi","role":"user"}'
    assert f[1, 2]["message"] == '{"content":"first","role":"tool","tool_call_id":"a"}'


def test_validation(spark):
    args = {"q": 5, "limit": 1.5, "deep": "yes", "score": 2, "tags": {}, "opt": [], "more": 1}
    rows = [
        (1, 0, "assistant", call(("a", "find", args), ("b", "find", {}), ("c", "nope", {}), ("d", "get", {"id": "x", "x": "$a"}))),
        (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "e", "name": "get", "arguments": "not json"}, {"name": "get", "arguments": {"id": None}}]})),
        *((1, 2 + i, "tool", result(x)) for i, x in enumerate("abcde")),
    ]
    got = {k[1]: r["errors"] for k, r in linked(spark, rows).items()}
    assert got["a"] == ["type:deep", "type:limit", "type:opt", "type:q", "type:tags", "unexpected:more"]
    assert got["b"] == ["missing:q"] and got["c"] == ["unknown_tool"] and got["d"] == [] and got["e"] == ["bad_arguments"]
    assert got[None] == ["no_result", "type:id"]


def test_cycles_repeats_and_dangling(spark):
    rows = [
        (1, 0, "assistant", call(("a", "get", {"id": "$b"}), ("b", "get", {"id": "$a"}), ("s", "get", {"id": "$s"}), ("t", "get", {"id": "$a"}), ("u", "get", {"id": "$gone"}))),
        (1, 1, "assistant", call(("u", "get", {}), ("v", "get", {"id": "$u"}))),
        (1, 2, "tool", result("u", "for the first u")),
    ]
    got = linked(spark, rows)
    for i, n in (("a", 0), ("b", 1), ("s", 2), ("t", 3)):
        assert got[1, i, 0, n]["level"] is None and "cycle" in got[1, i, 0, n]["errors"]
    assert got[1, "u", 0, 4]["errors"] == ["unresolved:gone"] and got[1, "u", 0, 4]["level"] == 0
    assert got[1, "u", 1, 0]["errors"] == ["duplicate_id", "no_result"]
    assert got[1, "v", 1, 1]["level"] == 1


def test_plain_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "{broken"), (None, None, None, None), (1, 2, "assistant", '{"a": 1}'), (1, 3, "user", ""), (1, 3, "user", ""), (2, 0, "assistant", '{"tool_calls": []}'), (3, 0, "system", "é\n\t\"q\" \\ /" + "x" * 100000)]
    out = formatted(table(spark, rows)).collect()
    assert len(out) == len(rows)
    by = sorted((str(r["conv_id"]), str(r["turn"]), r["message"]) for r in out)
    assert ("1", "0", '{"role":"user"}') in by and ("1", "1", '{"content":"{broken"}') in by and ("None", "None", "{}") in by
    assert ("1", "2", '{"content":"{\\"a\\": 1}","role":"assistant"}') in by and ("2", "0", '{"role":"assistant","tool_calls":[]}') in by
    assert json.loads(next(r["message"] for r in out if r["conv_id"] == 3))["content"] == rows[-1][3]
    assert formatted(table(spark, rows).limit(0)).count() == 0


def test_repeated_call_rows(spark):
    row = (1, 0, "assistant", call(("a", "find", {"q": "x"})))
    out = formatted(table(spark, [row, row, (1, 1, "tool", result("a"))]), TOOLS).where("role = 'assistant'").collect()
    assert len(out) == 2 and out[0] == out[1] and out[0]["n_calls"] == 1 and out[0]["n_linked"] == 1
