import itertools
import json
import random

import pytest
from graphs import props
from pyspark.sql import functions as F

from graphloom.functions import similarity as sim
from graphloom.model import NODE_SCHEMA
from graphloom.operators import linking
from graphloom.sources import files

TOWNS = {"data": {
    "Bridge": {"objectProperty": {"crosses": {"domain": ["Bridge"], "range": ["River"]}, "spans": {"domain": ["Bridge"], "range": ["River"]}, "builtBy": {"domain": ["Bridge"], "range": ["Firm"]}, "near": {"domain": ["Bridge"], "range": ["Town", "River"]}, "see": {"domain": ["Bridge"], "range": []}}, "datatypeProperty": {"name": {"domain": ["Bridge"], "range": ["string"]}, "built": {"domain": ["Bridge"], "range": ["int"]}}},
    "River": {"objectProperty": {}, "datatypeProperty": {"name": {"domain": ["River"], "range": ["string"]}, "length": {"domain": ["River"], "range": ["int"]}}},
    "Firm": {"objectProperty": {}, "datatypeProperty": {"name": {"domain": ["Firm"], "range": ["string"]}}},
    "Town": {"objectProperty": {}, "datatypeProperty": {"name": {"domain": ["Town"], "range": ["string"]}}},
}}


def schema(spark):
    return files.flatten_schema(spark.createDataFrame([(1, json.dumps(TOWNS))], "gid long, value string"))


def message(spark, *entities, msg=1):
    return spark.createDataFrame([(msg, 1, [json.dumps(e) for e in entities])], "msg_id long, gid long, data array<string>")


def graph(spark, *entities, **options):
    nodes, edges = linking.build_query_graph(message(spark, *entities), schema(spark), **options)
    rows = nodes.collect()
    name = {r.q_id: (r.labels[0], r.props["name"]["str"] if "name" in r.props else None) for r in rows}
    return sorted(name.values(), key=str), sorted((name[e.q_src], e.type, name[e.q_dst]) for e in edges.collect()), rows


def test_distances(spark):
    cases = [
        ({"name": "old stone arch1"}, {"name": "old stone arch2"}, 1 - 1 / 15),
        ({"name": "old stone arch1", "n": 3}, {"name": "old stone arch2", "n": 5}, 1 - (1 / 15 + 2 / 3) / 2),
        ({"name": ""}, {"name": ""}, 1.0),
        ({"_x": 1}, {"_x": 1}, 0.0),
        ({}, {"a": 1}, 0.0),
        ({"l": [1, 5]}, {"l": [5, 9]}, 1.0),
        ({"l": [1]}, {"l": [3]}, 1 / 3),
        ({"l": 1}, {"l": [3]}, 1 / 3),
        ({"l": []}, {"l": [3]}, 0.0),
        ({"t": "a" * 20 + "x"}, {"t": "a" * 20 + "y"}, 1.0),
        ({"b": True}, {"b": False}, 0.0),
        ({"b": True}, {"b": 1}, None),
        ({"t": "Мост 7"}, {"t": "Мост"}, 1 - 2 / 6),
    ]
    df = props(spark, [(a, b) for a, b, _ in cases])
    got = {r.q_id: r.sim for r in linking.similarity(df).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert got[i] == (None if want is None else pytest.approx(want)), cases[i]
    swapped = df.select("msg_id", "gid", "q_id", "d_id", F.col("d_props").alias("q_props"), F.col("q_props").alias("d_props"))
    assert {r.q_id: r.sim for r in linking.similarity(swapped).collect()} == pytest.approx({k: v for k, v in got.items() if v is not None} | {k: None for k, v in got.items() if v is None})
    assert linking.similarity(df, on_conflict="distance_one").where("q_id = 11").first().sim == 0.0
    assert linking.similarity(df, compat_list_dist=True).where("q_id = 6").first().sim == 1.0
    # each pair has a label of its own
    side = lambda c, i: df.select("gid", F.col("q_id").alias(i), F.array(F.concat(F.lit("L"), "q_id")).alias("labels"), F.col(c).alias("props"))
    q, d = side("q_props", "q_id").withColumn("msg_id", F.lit(1).cast("long")), side("d_props", "id")
    for st in (0.3, 0.8):
        left = {r.q_id for r in linking.candidates(q, d, st).collect()}
        assert left >= {i for i, s in got.items() if s is None or s >= st}
        assert not left & {i for i, (a, b, w) in enumerate(cases) if w is not None and w < st and "l" not in a}
    table = {r.q_id: r.sim for r in linking.similarity_table(q, d).collect()}
    assert table == {i: None if s is None else pytest.approx(s) for i, s in got.items()}
    names = spark.createDataFrame([(["ab"], ["abc", "x"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r.d for r in names.select(sim.alias_dist(F.col("a"), F.col("b")).alias("d")).collect()] == [pytest.approx(1 / 3), 1.0]


def test_query_graph_of_bridges(spark):
    nodes, edges, _ = graph(
        spark,
        {"label": "Bridge", "name": "Long Span", "crosses": "Wend", "builtBy": "Ost & Co", "unknown": 1},
        {"label": "River", "name": "Wend"},
        {"label": "Bridge", "name": "Low Span", "crosses": "Wend"},
    )
    assert nodes == [("Bridge", "Long Span"), ("Bridge", "Low Span"), ("Firm", "Ost & Co"), ("River", "Wend")]
    assert edges == [(("Bridge", "Long Span"), "builtBy", ("Firm", "Ost & Co")), (("Bridge", "Long Span"), "crosses", ("River", "Wend")), (("Bridge", "Low Span"), "crosses", ("River", "Wend"))]


def test_links_with_several_or_no_ranges(spark):
    nodes, edges, _ = graph(spark, {"label": "River", "name": "p"}, {"label": "Town", "name": "p"}, {"label": "Bridge", "name": "m", "near": "p", "see": "nobody"}, {"label": "Bridge", "name": "n", "see": "m"})
    assert edges == [(("Bridge", "m"), "near", ("Town", "p")), (("Bridge", "n"), "see", ("Bridge", "m"))]
    nodes, edges, _ = graph(spark, {"label": "River", "name": "p", "length": 3}, {"label": "Bridge", "name": "m", "crosses": "p", "near": "late"}, {"label": "Town", "name": "late"})
    assert len(nodes) == 4 and [e[1] for e in edges] == ["crosses"]


def test_links_find_nodes_without_properties(spark):
    _, edges, _ = graph(spark, {"label": "Town"}, {"label": "Bridge", "name": "m", "near": "x", "see": "y"})
    assert edges == [(("Bridge", "m"), "near", ("Town", None)), (("Bridge", "m"), "see", ("Town", None))]


def test_an_entity_with_many_links(spark):
    many = [f"r{i}" for i in range(70_000)]
    nodes, edges, _ = graph(spark, {"label": "Bridge", "name": "m", "crosses": many}, {"label": "Town", "name": "t"}, explode_links=True)
    assert len(nodes) == 70_002 and len(edges) == 70_000 and ("Town", "t") in nodes


def test_dedupe_by_subset(spark):
    two = ({"label": "River", "name": "p"}, {"label": "River", "name": "p", "length": 4}, {"label": "River", "name": "p", "length": 5})
    nodes, _, rows = graph(spark, *two)
    assert nodes == [("River", "p")] and len(rows[0].props) == 1
    _, _, rows = graph(spark, *two, merge_props=True)
    assert rows[0].props["length"]["num"] == 4
    _, edges, rows = graph(spark, {"label": "Bridge", "name": "m", "crosses": ["a", "b"]}, explode_links=True)
    assert len(edges) == 2
    _, edges, rows = graph(spark, {"label": "Bridge", "name": "m", "crosses": ["a", "b"]})
    assert len(edges) == 1 and any(r.props["name"]["kind"] == "list" for r in rows)


def test_bad_messages(spark):
    df = spark.createDataFrame([(1, 1, ['{"label": "Bridge"}']), (2, 1, ["{"]), (3, 1, ['{"name": "x"}']), (4, 1, ['{"label": "Alien"}']), (5, 1, [])], "msg_id long, gid long, data array<string>")
    assert {r.msg_id: r.reason for r in linking.bad_messages(df, schema(spark)).collect()} == {2: "no label", 3: "no label", 4: "unknown class", 5: "no entities"}


@pytest.mark.parametrize("seed", range(15))
def test_best_assignment_equals_enumeration(seed):
    rng = random.Random(seed)
    nodes = list(range(rng.randint(1, 4)))
    ranks = {n: [(rng.randint(0, 4), rng.choice([0.8, 0.9, 1.0])) for _ in range(rng.randint(1, 3))] for n in nodes}
    edges = {(a, b, x, y, "t") for a, b in itertools.permutations(nodes, 2) for x in range(5) for y in range(5) if rng.random() < 0.1}
    linked = {(a, b) for a, b, *_ in edges}
    best, chosen = -1, None
    for pick in sorted(itertools.product(*(range(len(ranks[n])) for n in nodes)), key=lambda p: p[::-1]):
        ids = {n: ranks[n][i][0] for n, i in zip(nodes, pick, strict=True)}
        score = sum(ranks[n][i][1] for n, i in zip(nodes, pick, strict=True)) + sum((a, b, ids[a], ids[b], "t") in edges for a, b in linked)
        if score > best + 1e-12:
            best, chosen = score, ids
    assert linking._best(nodes, ranks, edges) == chosen


def test_link_and_merge(spark):
    value = lambda x: {"kind": "str", "num": None, "str": x, "bool": None, "arr": None}
    tags = lambda *x: {"kind": "list", "num": None, "str": None, "bool": None, "arr": [{"kind": "str", "num": None, "str": i, "bool": None} for i in x]}
    stored = spark.createDataFrame([(5, ["Bridge", "Old"], {"name": value("Long Span"), "tags": value("a")}), (6, ["River"], {"name": value("Wend")}), (7, ["River"], {"name": value("Went")})], NODE_SCHEMA).withColumn("gid", F.lit(1).cast("long"))
    edges = spark.createDataFrame([(1, 5, "builtBy", 7)], "gid long, src long, type string, dst long")
    q = spark.createDataFrame([(1, 1, 0, ["Bridge"], {"name": value("Long Span"), "tags": tags("b", "a")}), (1, 1, 1, ["River"], {"name": value("Wend")}), (1, 1, 2, ["River"], {"name": value("zzzzzz")})], f"msg_id long, gid long, q_id long, labels array<string>, {NODE_SCHEMA.split(', ', 2)[2]}")
    links = spark.createDataFrame([(1, 1, 0, "builtBy", 1), (1, 1, 0, "crosses", 2)], "msg_id long, gid long, q_src long, type string, q_dst long")
    top = linking.top_k(linking.similarity(linking.block(q, stored)), st=0.4)
    assert {(r.q_id, r.d_id, r["rank"]) for r in top.collect()} == {(0, 5, 1), (1, 6, 1), (1, 7, 2)}
    found = linking.assign(top, linking.support(links, top, edges))
    # Went is less alike, but has the stored relation
    assert {(r.q_id, r.d_id) for r in found.collect()} == {(0, 5), (1, 7)}
    merged = {r.id: r for r in linking.merge_nodes(stored, found, q).collect()}
    assert len(merged) == 4 and sorted(x["str"] for x in merged[5].props["tags"]["arr"]) == ["a", "b"] and merged[7].props["name"]["str"] == "Wend" and merged[5].labels == ["Bridge", "Old"]
    wired = linking.rewire(links, found, q)
    fresh = linking.new_edges(wired, edges).collect()
    assert len(fresh) == 1 and fresh[0].type == "crosses" and fresh[0].dst < 0
    assert {(r.label, tuple(r.ids)) for r in linking.updated_labels(found, stored).collect()} == {("Bridge", (5,)), ("Old", (5,)), ("River", (7,))}


def test_values_are_merged_in_order(spark):
    one = lambda x: {"kind": "str", "num": None, "str": x, "bool": None, "arr": None}
    tags = lambda *x: {"kind": "list", "num": None, "str": None, "bool": None, "arr": [{"kind": "str", "num": None, "str": i, "bool": None} for i in x]}
    stored = spark.createDataFrame([(5, ["Town"], {"t": tags("a"), "u": one("s"), "v": one("s"), "w": one("s")})], NODE_SCHEMA).withColumn("gid", F.lit(1).cast("long"))
    sent = [{"t": tags("b"), "u": tags("x")}, {"t": one("k"), "u": tags("y", "x")}, {"t": tags("c", "k"), "v": tags("z")}, {"t": tags("d"), "v": one("q"), "w": tags()}]
    q = spark.createDataFrame([(m, 1, 0, ["Town"], p) for m, p in enumerate(sent)], f"msg_id long, gid long, q_id long, labels array<string>, {NODE_SCHEMA.split(', ', 2)[2]}")
    found = q.select("msg_id", "gid", "q_id", F.lit(5).cast("long").alias("d_id"))
    (row,) = linking.merge_nodes(stored, found, q).collect()
    plain = {k: [x["str"] for x in v["arr"]] if v["kind"] == "list" else v["str"] for k, v in row.props.items()}
    assert plain == {"t": ["k", "c", "d"], "u": ["s", "x", "y"], "v": "q", "w": ["s"]}


def test_a_text_is_parsed_once_and_its_properties_are_not_shuffled(spark, monkeypatch):
    plans, real = {}, linking.cut
    monkeypatch.setattr(linking, "cut", lambda df, name: (plans.update({name: df._jdf.queryExecution().analyzed().toString()}), real(df, name))[1])
    messages = spark.createDataFrame([(1, 1, ['{"label": "A", "name": "x", "to": "y", "other": 1}', "[1]", "no json"])], "msg_id long, gid long, data array<string>")
    rows = [(1, "A", "datatype", "name", None), (1, "A", "object", "to", ["B"])]
    schema = spark.createDataFrame(rows, "gid long, class string, kind string, prop string, range array<string>")
    q, e = linking.build_query_graph(messages, schema)
    assert sorted((r.labels[0], r.props["name"].str) for r in q.collect()) == [("A", "x"), ("B", "y")]
    assert [(r.type, r.q_src, r.q_dst) for r in e.collect()] == [("to", 0, 1)]
    assert sum("parse_json" in p or "parseJson" in p for p in plans.values()) == 1
