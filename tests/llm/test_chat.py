import json

import pytest
from pyspark.sql import functions as F

from leafmill.llm.chat import REPLY_SCHEMA, canonical_json, link, op8_chat, turns_as_calls


def rows_of(spark, rows):
    c = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, status string")
    return {(r["conv_id"], r["turn"], r["role"]): r for r in link(turns_as_calls(c), REPLY_SCHEMA).collect()}


def test_links_and_order(spark):
    got = rows_of(spark, [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 5, "user", "late"), (1, 9, "assistant", "alone"), (2, 0, "assistant", "b")])
    assert {k: v["status"] for k, v in got.items()} == {(1, 0, "system"): "message", (1, 1, "user"): "linked", (1, 2, "assistant"): "linked", (1, 5, "user"): "no_result", (1, 9, "assistant"): "no_call", (2, 0, "assistant"): "no_call"}
    assert (got[1, 2, "assistant"]["topo_turn"], got[1, 2, "assistant"]["topo_step"]) == (1, 1)


def test_a_result_written_before_its_call_follows_it_in_order(spark):
    m = spark.createDataFrame([(1, 0, "tool", "result", "x", "r", None), (1, 3, "assistant", "call", "x", None, ("hi", 2, 3)), (1, 4, "assistant", "call", "x", None, ("again", 5, 4))], "conv_id long, turn long, role string, kind string, link_id string, content string, arguments struct<content:string,n_chars:long,turn:long>")
    rows = sorted(link(m, REPLY_SCHEMA).collect(), key=lambda r: (r["topo_turn"], r["topo_step"], r["turn"]))
    assert [(r["kind"], r["status"]) for r in rows] == [("call", "linked"), ("result", "linked"), ("call", "repeated")]


def test_arguments_are_validated(spark):
    got = rows_of(spark, [(1, 0, "user", ""), (1, -1, "user", "x" * 401), (1, 2, "user", None), (1, 3, "user", "fine")])
    assert got[1, 0, "user"]["errors"] == "content:least"
    assert got[1, -1, "user"]["errors"] == "content:most,n_chars:most,turn:least"
    assert got[1, 2, "user"]["errors"] == "content:required,n_chars:required"
    assert got[1, 3, "user"]["errors"] == ""
    m = spark.createDataFrame([(1, 0, "a", "call", "x", None, (1, "?"))], "conv_id long, turn long, role string, kind string, link_id string, content string, arguments struct<content:long,extra:string>")
    assert link(m, REPLY_SCHEMA).first()["errors"] == "content:type,n_chars:required,turn:required,extra:unknown"


@pytest.mark.parametrize("text", ["plain", 'quote " and \\ back', "\x0b\x1f\x1a\n\t\r\b\f", r"\u000B stays", "é 漢 😀 /", "\x0b\\u000B\x0b\x0b"])
def test_json_is_canonical(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(canonical_json(F.struct("t"))).first()[0]
    assert got == json.dumps({"t": text}, ensure_ascii=False, separators=(",", ":"))


def test_nested_keys_are_sorted(spark):
    m = spark.createDataFrame([(1, 0, "a", "call", "x", None, ([{"z": 1, "b": {"y": 1, "a": 2}}],))], "conv_id long, turn long, role string, kind string, link_id string, content string, arguments struct<q:array<struct<z:int,b:struct<y:int,a:int>>>>")
    assert link(m, []).first()["json"] == '{"arguments":{"q":[{"b":{"a":2,"y":1},"z":1}]},"id":"x","role":"a","turn":0,"type":"call"}'


def test_odd_rows(spark):
    c = spark.createDataFrame([(1, 0, "user", "q"), (1, 0, "user", "q"), (None, 0, "user", "q"), (1, None, "user", None), (1, 1, None, "w"), (1, 1, "assistant", "long " * 100_000)], "conv_id long, turn long, role string, text string")
    rows = link(turns_as_calls(c), REPLY_SCHEMA).collect()
    assert len(rows) == 6 and all(json.loads(r["json"]) for r in rows)
    assert link(turns_as_calls(c.limit(0)), REPLY_SCHEMA).count() == 0


def test_no_python_on_the_path(spark):
    plan = op8_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Window" not in plan


def made(spark, rows):
    schema = "conv_id long, turn long, role string, kind string, link_id string, content string, tool string, needs array<string>, arguments struct<q:string,n:int,deep:boolean>, level int, spread long"
    return spark.createDataFrame([(*r, 9, 9) for r in rows], schema)


TOOLS = {"search": [("q", "string", True, 1, 10), ("n", "integer", False, 1, 5)], "open": [("deep", "boolean", True, None, None)], "count": [("q", "integer", True, None, None)]}


def test_calls_that_need_calls_come_after_their_results(spark):
    call = lambda conv, turn, i, needs, tool="search", a=("x", 2, None): (conv, turn, "assistant", "call", i, None, tool, needs, a)
    result = lambda conv, turn, i: (conv, turn, "tool", "result", i, f"r{i}", None, None, None)
    rows = [call(1, 1, "d", ["b", "c", "nobody"]), call(1, 2, "b", ["a", "a"]), call(1, 3, "c", []), call(1, 4, "a", None), result(1, 5, "a"), result(1, 6, "b"), result(1, 0, "c"), result(1, 7, "d"), (1, 8, "user", "message", None, "hi", None, None, None)]
    rows += [call(2, 1, "x", ["y"]), call(2, 2, "y", ["x"]), call(2, 3, "z", ["x"]), call(2, 4, "w", ["w"]), call(2, 5, "v", []), call(3, 1, "d", ["a"])]
    got = link(made(spark, rows), TOOLS).collect()
    assert len(got) == len(rows)
    order = [(r["kind"], r["link_id"]) for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["topo_turn"], r["topo_level"], r["topo_step"], r["turn"]))]
    at = {x: k for k, x in enumerate(order)}
    for i, needs in (("d", "bc"), ("b", "a"), ("c", ""), ("a", "")):
        assert at["call", i] < at["result", i] and all(at["result", n] < at["call", i] for n in needs)
    assert order[-1] == ("message", None)
    assert {r["link_id"]: r["topo_level"] for r in got if r["conv_id"] == 1 and r["kind"] == "call"} == {"a": 0, "b": 1, "c": 0, "d": 2}
    assert {r["link_id"]: r["status"] for r in got if r["conv_id"] == 2} == {"x": "circular", "y": "circular", "z": "circular", "w": "circular", "v": "no_result"}
    assert [r["topo_level"] for r in got if r["conv_id"] == 3] == [0]
    assert link(made(spark, []), TOOLS).count() == 0


def test_each_tool_has_its_schema(spark):
    rows = [(1, k, "assistant", "call", f"c{k}", None, tool, None, a) for k, (tool, a) in enumerate([("search", ("x", 2, None)), ("search", ("", 9, True)), ("search", None), ("open", (None, None, None)), ("open", (None, None, True)), ("count", ("7", None, None)), ("other", None), (None, None)])]
    got = {r["turn"]: (r["errors"], r["json"]) for r in link(made(spark, rows), TOOLS).collect()}
    assert [got[k][0] for k in range(8)] == ["", "q:least,n:most,deep:unknown", "q:required", "deep:required", "", "q:type", "tool:unknown", "tool:unknown"]
    assert got[4][1] == '{"arguments":{"deep":true},"id":"c4","role":"assistant","tool":"open","turn":4,"type":"call"}'


def test_calls_and_results_meet_in_a_hash_join(spark):
    plan = op8_chat(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
