"""Selective blocking loses nothing, and batches of messages are taken as if one after the other."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.model import PROP
from graphloom.operators import blocking, linking
from graphloom.sources import files
from graphloom.streaming import ingest

NODE = f"gid long, id long, labels array<string>, props map<string, {PROP}>"
QUERY = f"msg_id long, gid long, q_id long, labels array<string>, props map<string, {PROP}>"


def single(x):
    kind = "bool" if isinstance(x, bool) else "num" if isinstance(x, int | float) else "str"
    return {"kind": kind, **{k: (float(x) if k == "num" else x) if k == kind else None for k in ("num", "str", "bool")}}


def value(x):
    if isinstance(x, list):
        return {"kind": "list", "num": None, "str": None, "bool": None, "arr": [single(i) for i in x]}
    return {**single(x), "arr": None}


def random_props(r):
    word = lambda: "".join(r.choice("ab") for _ in range(r.choice([0, 1, 2, 5, 8, 19, 20, 21, 25])))
    near = lambda: r.choice(["Customer#000012345", "Customer#000012346", "Customer#000912345", "Kunde#12345", "Customer", "alphaland", "betaland", "alphland"])
    make = {
        "name": near, "mark": word, "size": lambda: r.choice([0.0, -0.0, 0.1, -0.2, 1, 1.24, 1.25, 5, 1e300]), "flag": lambda: r.random() < 0.5,
        "tags": lambda: r.choice([[], ["x"], ["x", "yellow"], "yellow"]), "_skip": lambda: r.random(), "odd": lambda: r.choice(["a", "b"]),
    }
    return {k: value(f()) for k, f in make.items() if r.random() < 0.5}


@pytest.mark.parametrize(("seed", "st", "rs"), [(1, 0.8, 0.0), (2, 0.5, 0.0), (3, 0.95, 0.0), (4, 0.6, 0.2), (5, 1.0, 0.0), (6, 0.0, 0.0), (7, 0.9, 0.2), (8, 0.3, 0.0)])
def test_candidates_hold_all_that_is_near(spark, seed, st, rs):
    r = random.Random(seed)
    labels = [["A"], ["B"], ["A", "B"]]
    stored = spark.createDataFrame([(r.choice([1, 1, 2]), i, r.choice(labels), random_props(r)) for i in range(160)], NODE)
    queries = spark.createDataFrame([(i // 2, 1, i, r.choice(labels), random_props(r)) for i in range(60)], QUERY)
    key = ("msg_id", "gid", "q_id", "d_id")
    whole = linking.similarity(linking.block(queries, stored), rs).collect()
    want = {tuple(x[k] for k in key) for x in whole if x.sim is None or x.sim >= st}
    found = linking.similarity(linking.candidates(queries, stored, st, rs), rs).collect()
    assert len(found) == len({tuple(x[k] for k in key) for x in found})
    assert want <= {tuple(x[k] for k in key) for x in found}
    assert {tuple(x[k] for k in key): x.sim for x in whole if x.sim is None or x.sim >= st} == {tuple(x[k] for k in key): x.sim for x in found if x.sim is None or x.sim >= st}
    assert {(x.msg_id, x.gid) for x in blocking.clashes(queries, stored).collect()} == {(x.msg_id, x.gid) for x in whole if x.sim is None}


def test_a_batch_finds_what_its_messages_find_alone(spark):
    one = lambda m, **p: (m, 1, 0, ["A"], {k: value(x) for k, x in p.items()})
    stored = spark.createDataFrame([(1, 1, ["A"], {"name": value("alphaland")}), (1, 2, ["A"], {"name": value("betaland"), "mark": value("zz")})], NODE)
    rows = [one(1, name="alphaland", mark="mmmm"), one(2, name="betaland"), one(3, mark="zz"), one(4, other=1.0)]
    near = lambda some: {(x.msg_id, x.d_id) for x in linking.similarity(linking.candidates(spark.createDataFrame(some, QUERY), stored, 0.8)).where("sim >= 0.8").collect()}
    got = near(rows)
    assert got == {(1, 1), (2, 2), (3, 2)}
    for row in rows[:2]:
        assert near([row]) == {p for p in got if p[0] == row[0]}


def test_few_pairs_are_compared(spark):
    r = random.Random(7)
    stored = spark.createDataFrame([(1, i, ["A"], {"name": value(f"Customer#{i:09d}"), "balance": value(r.uniform(-999, 9999)), "kind": value(r.choice(["red", "green"]))}) for i in range(3000)], NODE)
    queries = stored.where("id % 20 = 0").select(F.col("id").alias("msg_id"), "gid", F.lit(0).cast("long").alias("q_id"), "labels", "props")
    n = blocking.candidate_pairs(queries, stored, 0.8).count()
    assert 150 <= n < 0.01 * 150 * 3000


CLASSES = json.dumps({"data": {
    "Person": {"objectProperty": {"lives": {"domain": ["Person"], "range": ["Town"]}, "knows": {"domain": ["Person"], "range": ["Person"]}}, "datatypeProperty": {k: {"domain": ["Person"], "range": ["string"]} for k in ("name", "age", "tags")}},
    "Town": {"objectProperty": {}, "datatypeProperty": {"name": {"domain": ["Town"], "range": ["string"]}}},
}})


def random_line(r):
    people = ["Anna Maria Lang", "Anna Maria Lung", "Anna Mario Long", "Bert Stone", "Bert Stoner", "Cara Hill"]
    entity = {"label": "Person", "name": r.choice(people)}
    if r.random() < 0.6:
        entity["age"] = r.choice([30, 30.2, 30.4, 31, 45]) if r.random() < 0.93 else "old"
    if r.random() < 0.4:
        entity["tags"] = r.sample(["x", "y", "z"], r.randint(0, 2)) if r.random() < 0.7 else "w"
    if r.random() < 0.5:
        entity["lives"] = r.choice(["Upton", "Uptown", "Nether Wallop"])
    if r.random() < 0.3:
        entity["knows"] = r.choice(people)
    return json.dumps({"gid": r.choice([1, 1, 2]), "data": [entity]})


def graph_of(spark, store):
    """Nodes by what they hold, and edges between them."""
    nodes, edges = ingest.state(spark, store)
    plain = lambda v: sorted(str(i["num"] if i["kind"] == "num" else i["str"]) for i in v["arr"]) if v["kind"] == "list" else v["num"] if v["kind"] == "num" else v["str"]
    told = {r.id: (r.gid, r.labels[0], tuple(sorted((k, str(plain(v))) for k, v in r.props.items()))) for r in nodes.collect()}
    return sorted(told.values()), sorted((told[e.src], e.type, told[e.dst]) for e in edges.collect())


@pytest.mark.parametrize("seed", [int(x) for x in os.environ.get("LINK_SEEDS", "3").split(",")])  # more are slow
def test_one_batch_is_many_of_one_message(spark, tmp_path, seed):
    r = random.Random(seed)
    lines = [random_line(r) for _ in range(4)]
    schema = files.flatten_schema(spark.createDataFrame([(g, CLASSES) for g in (1, 2)], "gid long, value string")).cache()
    rows = lambda some: spark.createDataFrame([(i, x) for i, x in some], "arrival long, value string")
    whole, single_ = (str(tmp_path / x) for x in ("whole", "single"))
    ingest.ingest_batch(rows(list(enumerate(lines))), 0, whole, schema)
    for i, line in enumerate(lines):
        ingest.ingest_batch(rows([(i, line)]), i, single_, schema)
    want = graph_of(spark, single_)
    assert graph_of(spark, whole) == want
    dead = lambda store: sorted((x.value, x.reason) for x in spark.read.parquet(f"{store}/dead_letters").collect())
    assert dead(whole) == dead(single_)


def _many_labels(spark):
    q = spark.createDataFrame([(1, 1, 0, ["A"], {}), (1, 1, 1, ["B", "A"], {}), (2, 1, 0, ["C"], {}), (3, 2, 0, ["A"], {})], QUERY)
    d = spark.createDataFrame([(1, i, [["A"], ["A", "B"], ["B", "A"], ["B"], ["D"]][i % 5], {}) for i in range(23)], NODE)
    return q, d


def test_sizes_of_blocks_without_pairs(spark):
    q, d = _many_labels(spark)
    some = linking.block(q, d).groupBy("msg_id", "gid", "q_id").agg(F.count(F.lit(1)).alias("n"), F.min("d_id").alias("least"), F.max("d_id").alias("most"))
    got = sorted(map(tuple, linking.block_sizes(q, d).collect()))
    assert got == sorted(map(tuple, some.collect())) == [(1, 1, 0, 15, 0, 22), (1, 1, 1, 19, 0, 22)]


def test_pairs_of_one_label_are_spread(spark):
    """One label and one file: its pairs are made by many tasks, and each once."""
    q, d = _many_labels(spark)
    q = q.where("q_id = 0 AND gid = 1 AND msg_id = 1").select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long"))).alias("msg_id"), "gid", "q_id", "labels", "props")
    d = spark.range(300).coalesce(1).select(F.lit(1).cast("long").alias("gid"), "id", F.array(F.lit("A")).alias("labels"), F.create_map().cast(f"map<string, {PROP}>").alias("props"))
    met = linking.block(q, d).select("msg_id", "d_id", F.spark_partition_id().alias("task"))
    sizes = [r["count"] for r in met.groupBy("task").count().collect()]
    assert sum(sizes) == 40 * 300 == met.select("msg_id", "d_id").distinct().count()
    assert len(sizes) > 4 and max(sizes) < 6000


def test_pairs_of_classes_that_share_most_signatures_are_scored_in_a_grid(spark):
    """Names of one form, as customers' are: nearly all share a piece. The pairs are not made by signatures, and the result is all there is."""
    def props(i, form):
        out = {"name": form.format(i)} if i % 5 else {"tags": [f"tag {i % 3}", "z"]}
        if i % 3 == 0:
            out["size"] = i % 7 if i % 2 else "odd" if i % 4 == 2 else i
        if i % 4 == 0:
            out["tags"] = [f"tag {i % 2}"] if i % 8 else "tag 1"
        return {k: value(v) for k, v in {**out, "_key": i}.items()}

    labels = lambda i: ["A", "B"] if i % 2 else ["B"]
    q = spark.createDataFrame([(i, 1, 0, labels(i), props(i, "Customer#0000{:03d}")) for i in range(30)], QUERY)
    d = spark.createDataFrame([(1, i, labels(i + 1), props(i, "Customer#00001{:02d}")) for i in range(40)], NODE)
    assert blocking.split_pairs(q, d, 0.7)[1].count() > 0
    key = lambda df: sorted((r.msg_id, r.d_id, round(r.sim, 9)) for r in df.collect())
    found = key(linking.near(q, d, 0.7))
    assert found == key(linking.similarity(linking.block(q, d)).where("sim >= 0.7")) and found
    # nothing but the broad classes meets in the grid, and all of a selective one comes by signatures
    alone = spark.createDataFrame([(1, 1, 0, ["A"], {"size": value(5)}), (2, 1, 0, ["A"], {"size": value(900)})], QUERY)
    sizes = spark.createDataFrame([(1, i, ["A"], {"size": value(i)}) for i in range(300)], NODE)
    pairs, broad = blocking.split_pairs(alone, sizes, 0.8)
    assert broad.count() == 0 and {(r.msg_id, r.d_id) for r in pairs.collect()} >= {(1, 5)}
    assert key(linking.near(alone, sizes, 0.8)) == [(1, 5, 1.0)]


def test_clashes_in_time_are_found_without_meeting_every_version(spark):
    r = random.Random(5)
    pick = lambda: r.choice([1, 2.5, "a", True, ["b"], [2, "c"]])
    asked = [(m, r.randrange(2), 0, ["A"], {k: pick() for k in r.sample("xyz", 2)}) for m in range(1, 40)]
    held = [(r.randrange(2), ["A"], {r.choice("xyz"): pick()}, *r.choice([(None, None), (None, 9), (7, 12), (12, 15), (20, 21), (30, None)])) for _ in range(6)]
    as_kinds = lambda x: {single(i)["kind"] for i in (x if isinstance(x, list) else [x])}
    want = {(m, g) for m, g, _, _, props in asked for h, _, old, since, until in held for k in props if g == h and k in old and len(as_kinds(props[k]) | as_kinds(old[k])) > 1 and (since is None or since < m) and (until is None or until >= m)}
    valued = lambda p: {k: value(v) for k, v in p.items()}
    q = spark.createDataFrame([(*x[:4], valued(x[4])) for x in asked], QUERY)
    d = spark.createDataFrame([(g, labels, valued(p), *t) for g, labels, p, *t in held], f"gid long, labels array<string>, props map<string, {PROP}>, since long, until long")
    assert {tuple(x) for x in blocking.clashes(q, d).collect()} == want and want
    # 60,000 messages and as many versions of a value: to meet them all would be 3,600,000,000 pairs
    text = F.create_map(F.lit("x"), F.lit(None).cast(PROP)).cast(f"map<string, {PROP}>")
    text = F.transform_values(text, lambda k, v: F.struct(F.lit("str").alias("kind"), v["num"].alias("num"), k.alias("str"), v["bool"].alias("bool"), v["arr"].alias("arr")))
    many = spark.range(60_000).select(F.lit(1).cast("long").alias("gid"), F.array(F.lit("A")).alias("labels"), text.alias("props"), F.col("id").alias("n"))
    versions = many.withColumn("since", F.col("n")).withColumn("until", F.col("n") + 1)
    assert blocking.clashes(many.withColumnRenamed("n", "msg_id"), versions).isEmpty()


def test_signatures_of_query_nodes_are_spread_and_not_aggregated(spark):
    one = [(i, 1, 0, ["A"], {"name": value(f"name of {i}"), "tags": value(["a", "a", i])}) for i in range(40)]
    q, d = spark.createDataFrame(one, QUERY).coalesce(1), spark.createDataFrame([(1, i, ["A"], x[4]) for i, x in enumerate(one)], NODE)
    mine, _ = blocking._signed(q, d, blocking.probes(q, blocking.statistics(d), 0.2))
    assert mine.rdd.getNumPartitions() >= 8 and mine.count() == mine.distinct().count() > 40
    plan = mine._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [msg_id" not in plan
