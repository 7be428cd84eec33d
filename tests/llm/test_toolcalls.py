import json

import pytest

from bundleflow.llm import toolcalls

CALLS = "conv_id long, turn long, calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, text string"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMA = [("add", "a", "integer", True), ("add", "b", "number", False), ("say", "text", "string", True), ("say", "loud", "boolean", False), ("deep", "o", "object", True), ("deep", "l", "array", True)]


@pytest.fixture
def run(spark):
    def link(messages, results):
        rows = toolcalls.link(
            spark.createDataFrame([(*m, "x") for m in messages], CALLS), spark.createDataFrame(results, RESULTS),
            spark.createDataFrame(SCHEMA, "tool string, parameter string, type string, required boolean"),
        ).collect()
        return {(r.conv_id, r.turn, r.call_id): r for r in rows}, rows

    return link


def test_links_orders_and_serialises(run):
    messages = [
        (1, 0, [("p", "add", '{"b": 1.5, "a": 2}', ["q"]), ("q", "say", ' { "text" : "h\\u00e9\\"i" } ', ["r"]), ("r", "add", '{"a":1}', [])]),
        (1, 4, [("s", "say", '{"text":"z"}', ["p", "nobody"]), ("t", "deep", '{"o":{"z":1,"a":[]},"l":[1,"x",null]}', ["p"])]),
        (2, 0, [("p", "say", '{"text":"other"}', None)]),
    ]
    results = [(1, 1, "p", "P"), (1, 2, "p", "late"), (1, 1, "q", "Q"), (1, 0, "r", "too early"), (1, 5, "t", None), (2, 1, "p", "two"), (2, 1, "ghost", "g"), (3, 1, "p", "no such conversation")]
    got, rows = run(messages, results)
    assert len(rows) == 8
    assert [(k[2], got[(1, 0, k[2])].step) for k in got if k[:2] == (1, 0)].__len__() == 3
    assert {i: got[(1, 0, i)].step for i in "pqr"} == {"r": 1, "q": 2, "p": 3}
    assert {k: r.status for k, r in got.items()} == {
        (1, 0, "p"): "ok", (1, 0, "q"): "ok", (1, 0, "r"): "no_result", (1, 4, "s"): "unresolved", (1, 4, "t"): "ok", (2, 0, "p"): "ok",
        (2, 1, "ghost"): "orphan_result", (3, 1, "p"): "orphan_result",
    }
    assert got[(1, 0, "p")].canonical == '{"arguments":{"a":2,"b":1.5},"id":"p","name":"add","result":"P"}' and got[(1, 0, "p")].n_results == 2
    assert got[(1, 4, "t")].canonical == '{"arguments":{"l":[1,"x",null],"o":{"a":[],"z":1}},"id":"t","name":"deep","result":null}'
    assert json.loads(got[(1, 0, "q")].canonical)["arguments"] == {"text": 'hé"i'}


def test_arguments(run):
    bad = {
        '{"a": "x"}': "type:a", '{"b": true}': "missing:a,type:b", '{"a": 1, "c": 1}': "unknown:c", "[1]": "not_json", "{": "not_json", "": "not_json", None: "not_json", "{}": "missing:a",
        '{"a": 1}': "", '{"a": 1.5}': "type:a", '{"a": null}': "type:a", '{"a": 12345678901234567890123}': "",
    }
    messages = [(1, i, [(f"c{i}", "add", a, [])]) for i, a in enumerate(bad)] + [(1, 99, [("z", "none", "{}", []), (None, "add", "{}", [])]), (None, 1, [("n", "add", '{"a":1}', [])])]
    got, rows = run(messages, [(1, 200, f"c{i}", "r") for i in range(len(bad))])
    assert {a: got[(1, i, f"c{i}")].errors for i, a in enumerate(bad)} == bad
    assert got[(1, 99, "z")].errors == "unknown_tool" and got[(None, 1, "n")].status == "no_result" and len(rows) == len(bad) + 2


def test_circles_and_repeated_ids(run):
    messages = [(1, 0, [("a", "say", '{"text":""}', ["b"]), ("b", "say", '{"text":""}', ["a"]), ("c", "say", '{"text":""}', [])]), (2, 0, [("d", "say", '{"text":""}', []), ("d", "say", '{"text":""}', [])]), (2, 1, None), (2, 2, [])]
    got, rows = run(messages, [(1, 1, "a", ""), (2, 1, "d", "")])
    assert [got[(1, 0, i)].status for i in "abc"] == ["circular", "circular", "no_result"]
    assert [r.status for r in rows if r.conv_id == 2] == ["duplicate_call"] * 2
    assert run([], [])[1] == []
