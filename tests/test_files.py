import json
import os
import re

import pytest
from graphs import make, node, props
from pyspark.sql import functions as F
from test_linking import TOWNS, schema

from graphloom.functions.keywords import edge_keywords, property_words
from graphloom.model import NODE_SCHEMA
from graphloom.operators import evaluation
from graphloom.sources import files
from graphloom.streaming import ingest

VALUE = lambda x: {"kind": "str", "num": None, "str": x, "bool": None, "arr": None}


def test_entity_csv(spark, tmp_path):
    nodes = spark.createDataFrame([(1, ["A", "B"], {"name": VALUE('x, "y"')}), (2, ["A"], {})], NODE_SCHEMA)
    files.write_entity_csv(nodes, str(tmp_path / "csv"))
    assert sorted((r[":ID"], r.name, r.label) for r in files.read_entity_csv(spark, str(tmp_path / "csv")).collect()) == [(1, 'x, "y"', "A"), (1, 'x, "y"', "B"), (2, None, "A")]
    first = next((tmp_path / "csv" / "label=A").glob("*.csv")).read_text().splitlines()
    assert first[0] == ":ID,name"


def test_triples(spark, tmp_path):
    (tmp_path / "t.csv").write_text("subject,predicate,object\na,r,b\na,r,b\nb,s,a\n,r,c\n")
    nodes, edges = files.triples_to_graph(files.read_triples(spark, str(tmp_path / "t.csv")))
    name = {r.id: r.props["name"]["str"] for r in nodes.collect()}
    assert sorted(name.values()) == ["a", "b"] and sorted((name[e.src], e.type, name[e.dst]) for e in edges.collect()) == [("a", "r", "b"), ("b", "s", "a")]


def test_messages_and_schema(spark):
    lines = spark.createDataFrame([('{"gid": 3, "host": "h", "boltport": "1", "data": [{"label": "A", "n": 1.0}]}',), ("{",), ('{"data": [{}]}',), ('{"gid": 3, "data": []}',), (None,)], "value string")
    rows = files.decode_messages(lines).collect()
    assert [r.reason for r in rows] == [None, "malformed", "no gid", "no entities", "malformed"]
    assert rows[0].gid == 3 and json.loads(rows[0].data[0]) == {"label": "A", "n": 1.0}
    flat = schema(spark)
    assert flat.count() == sum(len(c[k]) for c in TOWNS["data"].values() for k in c)
    assert {r["class"] for r in files.class_schema(flat, 1, ["Town", "None"]).collect()} == {"Town"} and files.class_schema(flat, 2, ["Town"]).count() == 0


def log(kind, code, n=1):
    return f"2020-01-01 INFO logPattern, round: {n}, patternType: {kind}, hashCode: {code}, startRelType: x, other"


def test_pattern_logs(spark, tmp_path):
    kinds = ["autoPruningExistence"] * 19 + ["manualMeaningless"] * 6 + ["manualLabel"]
    (tmp_path / "a.txt").write_text("\n".join(["noise", *(log(k, i) for i, k in enumerate(kinds)), log("auto", "only-here")]))
    (tmp_path / "b.txt").write_text("\n".join(log("manualLabel", i) for i in range(26)))
    logs = files.read_pattern_logs(spark, {"pruning": str(tmp_path / "a.txt"), "default": str(tmp_path / "b.txt")})
    assert {tuple(r) for r in evaluation.pattern_counts(logs).collect()} == {("pruning", 27), ("default", 26)}
    a, b = evaluation.joint(logs.where("run = 'pruning'"), logs.where("run = 'default'"))
    assert a.count() == b.count() == evaluation.joint_hashes(a, b).count() == 26
    assert round(evaluation.auto_ratio(a).first()[0], 6) == 0.730769
    assert [round(x, 6) for x in evaluation.prune_metrics(a).first()] == [19, 0, 6, 1, 0.769231, 1.0, 0.76]
    none = logs.limit(0)
    assert evaluation.auto_ratio(none).first()[0] is None and evaluation.prune_metrics(none).first().accuracy is None


def test_edge_keywords(spark):
    n, e = make(spark, [(1, ["Film"], {"name": VALUE("Red Sun")}), (2, ["Person"], {"name": VALUE(" Ann ")}), node(3, "Empty")], [(1, "by", 2), (1, "by", 3)])
    got = {r.edge_id: r.keywords for r in edge_keywords(n, e).collect()}
    assert got["by|1|2|0"] == sorted(["Film", "Person", "Red Sun", "Ann", "Red", "Sun", "Film", "Film", "Red Sun", "Ann", "Red", "Sun", "Ann"])
    assert property_bag(spark, {"name": "Red Sun", "n": 3, "tags": ["old film", "Sun"], "by": "Ann"}) == ["Ann", "Red", "Sun", "film", "old"]
    assert got["by|1|3|1"] == sorted(["Film", "Empty", "Red Sun", "Red", "Sun", "Film", "Film", "Red Sun", "Red", "Sun"])


def test_keywords_are_put_together_per_node(spark):
    """An edge is moved with two arrays for each end, and its bag is sorted by a compiled function."""
    n, e = make(spark, [(1, ["P", "Q"], {"name": VALUE("Q b"), "x": VALUE("b a")}), (2, ["Q"], {"name": VALUE("b")})], [(1, "r", 2), (2, "r", 2)])
    out = edge_keywords(n, e)
    got = {r.edge_id: r.keywords for r in out.collect()}
    assert got["r|1|2|0"] == sorted(["P", "Q", "Q b", "b", "a", "P", "Q", "P", "Q", "Q b", "b", "Q", "b", "b"])
    assert got["r|2|2|1"] == sorted(["Q", "b", "Q", "Q", "b", "b", "b", "b"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_union(" in plan and "sort_array(" in plan and "array_sort(" not in plan


def test_keywords_of_several_names(spark):
    text = lambda x: {"kind": "str", "num": None, "str": x, "bool": None}
    both = {"kind": "list", "num": None, "str": None, "bool": None, "arr": [text("ann bo"), text(" "), text("Eve")]}
    n, e = make(spark, [(1, ["P"], {"name": both}), (2, ["Q"], {"name": VALUE("cy dee")})], [(1, "r", 2)])
    assert edge_keywords(n, e).first().keywords == sorted(["P", "Q", "ann bo", "Eve", "cy dee", "ann", "bo", "cy", "dee", "P", "P", "ann bo", "Eve", "cy dee", "ann", "bo", "Eve", "cy", "dee"])


def property_bag(spark, values):
    df = props(spark, [(values, {})])
    return df.select(F.array_sort(property_words(F.col("q_props"))).alias("w")).first().w


def test_stream_equals_batches_and_runs_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    first = {"gid": 1, "data": [{"label": "Bridge", "name": "Low Span1", "crosses": "Wend"}]}
    second = {"gid": 1, "data": [{"label": "Bridge", "name": "Low Span2", "built": 7, "spans": "Wend"}]}
    other = {"gid": 2, "data": [{"label": "Bridge", "name": "x"}]}
    store, check = str(tmp_path / "store"), str(tmp_path / "check")

    def run(name, lines):
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
        query = ingest.start_ingest(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")), store, schema(spark), check, available_now=True)
        query.awaitTermination()

    run("a.txt", [json.dumps(first), "{", json.dumps(other)])
    nodes, edges = ingest.state(spark, store)
    assert sorted((r.gid, r.labels[0], r.props["name"]["str"]) for r in nodes.collect()) == [(1, "Bridge", "Low Span1"), (1, "River", "Wend")]
    dead = {r.reason for r in spark.read.parquet(f"{store}/dead_letters").collect()}
    assert dead == {"malformed", "unknown class"}
    run("b.txt", [json.dumps(second)])
    nodes, edges = ingest.state(spark, store)
    rows = {r.props["name"]["str"]: r for r in nodes.collect()}
    assert set(rows) == {"Wend", "Low Span2"} and rows["Low Span2"].props["built"]["num"] == 7 and edges.count() == 2
    before = sorted(map(str, nodes.collect()))
    again = spark.read.text(str(tmp_path / "in" / "b.txt"))
    last = spark.read.parquet(f"{store}/commits").agg(F.max("batch")).first()[0]
    ingest.ingest_batch(again, last, store, schema(spark))
    assert sorted(map(str, ingest.state(spark, store)[0].collect())) == before and ingest.state(spark, store)[1].count() == 2


def _line(gid, **entity):
    return json.dumps({"gid": gid, "data": [{"label": "Person", **entity}]})


@pytest.mark.parametrize("files_per_batch", [1, 20])
def test_messages_are_taken_in_order(spark, tmp_path, monkeypatch, files_per_batch):
    """A stream of many batches leaves what one batch leaves; old bases and batches go."""
    monkeypatch.setattr(ingest, "COMPACT", 3)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(8):
        (folder / f"{i}.txt").write_text("\n".join([_line(1, name="Anna Maria Lang", age=1 + i / 100), "{", _line(2, name=f"somebody number {i}" if i % 2 else "Anna Maria Lang", age=i)]))
        os.utime(folder / f"{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))
    store = str(tmp_path / "store")
    stream = files.message_stream(spark, str(folder), maxFilesPerTrigger=files_per_batch)
    classes = people(spark, 1, 2)
    ingest.start_ingest(stream, store, classes, str(tmp_path / "check"), available_now=True).awaitTermination()
    nodes, _ = ingest.state(spark, store)
    rows = nodes.collect()
    one = [r for r in rows if r.gid == 1]
    assert len(one) == 1 and one[0].props["age"]["num"] == pytest.approx(1.07)
    assert {r.reason for r in spark.read.parquet(f"{store}/dead_letters").collect()} == {"malformed"}
    if files_per_batch == 1:
        assert len(ingest._batches(spark, store, "bases")) == 2 and len(ingest._batches(spark, store, "commits")) <= 6


def people(spark, *gids):
    text = json.dumps({"data": {"Person": {"objectProperty": {}, "datatypeProperty": {"name": {"domain": ["Person"], "range": ["string"]}, "age": {"domain": ["Person"], "range": ["int"]}}}}})
    return files.flatten_schema(spark.createDataFrame([(g, text) for g in gids], "gid long, value string"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_base_is_read_by_graph_and_not_moved(spark, tmp_path, monkeypatch):
    """Rows laid over a base move none of it; the graphs of a batch name the folders that are read; another session finds the buckets."""
    store = str(tmp_path / "st'ore")
    base = [(g, i, ["A"], {"name": VALUE(f"{g}-{i}")}, None, None) for g in range(40) for i in range(5)]
    nodes, edges = spark.createDataFrame(base, ingest.NODES), spark.createDataFrame([(g, i, "r", i + 1) for g in range(40) for i in range(4)], ingest.EDGES)
    ingest.save_base(nodes, edges, store, -1)
    changed = spark.createDataFrame([(3, 1, ["A"], {"name": VALUE("new")}, None, None), (None, 9, ["A"], {}, None, None)], ingest.NODES)
    ingest.save_changes(changed, spark.createDataFrame([(3, 1, "s", 4), (5, 0, "s", 1)], ingest.EDGES), spark.createDataFrame([(3, 7)], "gid long, upto long"), store, 0)
    for name in ingest.KEYS:  # as in a session of its own
        spark.sql(f"DROP TABLE {ingest._table(store, name, -1)}")
    asked = spark.createDataFrame([(3,), (3,), (99,), (None,)], "gid long")
    some, links = ingest.state(spark, store, gids=asked)
    assert sorted((r.gid, r.id, r.props["name"]["str"]) for r in some.collect()) == [(3, i, "new" if i == 1 else f"3-{i}") for i in range(5)]
    assert sorted(map(tuple, links.collect())) == [*((3, i, "r", i + 1) for i in range(1)), (3, 1, "r", 2), (3, 1, "s", 4), (3, 2, "r", 3), (3, 3, "r", 4)]
    every, links = ingest.state(spark, store)
    assert every.count() == 201 and links.count() == 162
    assert re.search(r"PartitionFilters: \[[^\]]*part#", _plan(some))
    # no broadcast, as with many changes
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(ingest.state(spark, store)[0].where("id >= 0"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "Scan parquet" in x and "Bucketed: true" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, at = [], depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < at:
            above.append(x)
            at = depth(x)
    join = next(i for i, x in enumerate(above) if "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in above[:join]), plan
