import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import toolcalls as tc

SCHEMA = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "number", "maximum": 9}}, "additionalProperties": False}}


def run(spark, calls, results):
    c = spark.createDataFrame(calls, "conv_id string, call_id string, turn long, tool string, arguments string")
    r = spark.createDataFrame(results, "conv_id string, call_id string, turn long, content string")
    return tc.link(c, r, SCHEMA).collect()


def test_linking_order_and_validation(spark):
    ref = lambda x: json.dumps({"a": {"$ref": x}})
    calls = [
        ("c", "1", 0, "add", '{"b": 2.0, "a": 1}'), ("c", "2", 2, "add", ref("1")), ("c", "3", 4, "add", ref("2")), ("c", "4", 6, "add", ref("nowhere")),
        ("c", "x", 7, "add", ref("y")), ("c", "y", 8, "add", ref("x")), ("c", "z", 9, "add", ref("x")), ("c", "s", 9, "add", ref("s")),
        ("c", "1", 5, "add", "{"), ("d", "1", 0, "sub", "{}"), ("d", "2", 0, "add", None), ("d", "3", 0, "add", '{"a": 1, "b": 10}'), ("d", "4", 0, "add", '{"a": true}'),
        (None, "1", 0, "add", '{"a": 1}'), ("d", None, 0, "add", '{"a": 1, "q": 1}'), ("d", "5", 3, "add", '{"a": NaN}'), ("d", "5", 3, "add", '{"a": NaN}'),
    ]
    results = [("c", "1", 1, '{"é": 1.0}'), ("c", "1", 3, "late"), ("c", "2", 1, "early"), ("d", "9", 1, "orphan"), (None, "1", 1, "x"), ("d", "4", 2, None)]
    rows = run(spark, calls, results)
    assert len(rows) == len(calls) + 3  # the late result, the orphan, and that without a conversation
    by = {(r.conv_id, r.call_id, r.turn): r for r in rows}
    one = by["c", "1", 0]
    assert one.status == "linked" and one.valid and one.record == '{"arguments":{"a":1,"b":2},"id":"1","name":"add","result":{"é":1},"status":"linked"}'
    assert [by["c", str(i), t].level for i, t in ((1, 0), (2, 2), (3, 4), (4, 6))] == [0, 1, 2, 0]
    assert all(by["c", i, t].level is None for i, t in (("x", 7), ("y", 8), ("z", 9), ("s", 9)))
    assert by["c", "2", 2].status == "early" and by["c", "1", 5].status == "duplicate" and by["c", "3", 4].status == "unanswered"
    assert by["c", "1", 5].fault == "malformed JSON" and by["d", "1", 0].fault == "unknown tool" and by["d", "2", 0].fault == "no arguments"
    assert by["d", "3", 0].fault == "$.b: maximum is 9" and by["d", "4", 0].fault == "$.a: not of type integer" and by["d", None, 0].fault == "$.q: unknown"
    assert by["d", "9", 1].status == "orphan" and by["d", "9", 1].record == '{"id":"9","result":"orphan","status":"orphan"}' and by["d", "4", 0].status == "linked"
    assert by[None, "1", 0].status == "unanswered" and by["d", "5", 3].fault == "malformed JSON"
    assert by["c", "1", 3].status == "extra" and one.n_results == 2 and by[None, "1", 1].status == "orphan"


def test_order_is_topological(spark):
    conversations = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if t != 3 else None) for t in range(40)], "conv_id long, turn long, role string, text string")
    rows = tc.link(*tc.transcript_calls(conversations), tc.TRANSCRIPT_SCHEMAS).collect()
    level = {r.call_id: r.level for r in rows}
    assert len(rows) == 20 and all(r.valid and r.status == "linked" for r in rows)
    for r in rows:
        for x in json.loads(r.record)["arguments"].get("after", []):
            if x["$ref"] in level:
                assert level[x["$ref"]] < r.level


def test_messages_and_empty_tables(spark):
    m = spark.createDataFrame([("c", 0, "assistant", '{"tool_calls": [{"id": "1", "name": "add", "arguments": "{}"}]}'), ("c", 1, "tool", '{"tool_call_id": "1", "content": "2"}'), ("c", 2, "assistant", "words"), ("c", 3, "tool", None)], "conv_id string, turn long, role string, text string")
    calls, results = tc.calls_of(m)
    assert calls.count() == 1 and results.count() == 1
    assert run(spark, [], []) == []


def test_every_result_is_returned(spark):
    results = [("c", "1", 1, "x"), ("c", "1", 1, "x"), ("c", "1", None, None), ("c", None, 1, "k"), ("e", "1", 1, "o"), ("e", "1", 1, "o")]
    rows = run(spark, [("c", "1", 0, "add", '{"a": 1}')], results)
    assert sorted(r.status for r in rows) == ["extra", "extra", "linked", "orphan", "orphan", "orphan"]


def test_references_are_read_from_json(spark):
    calls = [("c", "é", 0, "add", '{"a": 1}'), ("c", "2", 1, "add", json.dumps({"a": {"$ref": "é"}})), ("c", "3", 2, "add", '{"a": [{"\\u0024ref": "2"}], "b": "{\\"$ref\\": \\"no\\"}"}')]
    assert {r.call_id: r.level for r in run(spark, calls, [])} == {"é": 0, "2": 1, "3": 2}


@pytest.mark.parametrize("group", [tc.GROUP, 3])
def test_levels_equal_a_plain_version(spark, monkeypatch, group):
    monkeypatch.setattr(tc, "GROUP", group)
    import random

    rng = random.Random(5)
    refs = {(c, i): [rng.randrange(12) for _ in range(rng.randrange(3))] for c in "ab" for i in range(12)}
    calls = [(c, str(i), i, "add", json.dumps({"a": [{"$ref": str(x)} for x in r]})) for (c, i), r in refs.items()]

    def level(c, i, seen=()):
        if (c, i) in seen:
            return None
        below = [level(c, x, (*seen, (c, i))) for x in refs[c, i]]
        return None if None in below else max(below, default=-1) + 1

    got = {(r.conv_id, int(r.call_id)): r.level for r in run(spark, calls, [])}
    assert got == {k: level(*k) for k in refs}


def test_a_long_run_is_one_round(spark):
    calls = [("c", str(i), i, "add", json.dumps({"a": {"$ref": str(i - 1)}}) if i else "{}") for i in range(20_000)]
    assert all(r.level == int(r.call_id) for r in run(spark, calls, []))


@pytest.mark.parametrize("raw, fault", [('{"a":1e999}', "number out of range"), ("[" * 3000 + "]" * 3000, "nested too deeply"), ("[" * 100_000, "nested too deeply"), ('{"a":' + "9" * 400 + "}", "number out of range"), ('{"a":"\\ud800"}', "$.a: not of type integer"), ('{"\\ud800":1}', "$.a: missing")])
def test_odd_json(spark, raw, fault):
    (row,) = run(spark, [("c", "1", 0, "add", raw)], [("c", "1", 1, raw)])
    assert row.fault == fault and json.loads(row.record)["id"] == "1"


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=())), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_canonical_keeps_values(value):
    text = tc.canonical(tc.load(json.dumps(value)))
    assert json.loads(text) == json.loads(json.dumps(value)) and tc.canonical(tc.load(text)) == text and text.encode()


def test_calls_of_one_identifier_and_turn(spark):
    """The references of all of them count, so the order holds."""
    c = spark.createDataFrame([("c", "2", 1, "f", '{"b": 1}'), ("c", "2", 1, "f", '{"z": {"$ref": "3"}}'), ("c", "3", 0, "f", '{"a": {"$ref": "4"}}'), ("c", "4", 0, "f", "{}")], "conv_id string, call_id string, turn long, tool string, arguments string")
    r = spark.createDataFrame([], "conv_id string, call_id string, turn long, content string")
    assert sorted((x.call_id, x.level, x.status) for x in tc.link(c, r, {}).collect()) == [("2", 2, "unanswered"), ("2", 2, "unanswered"), ("3", 1, "unanswered"), ("4", 0, "unanswered")]
