"""Queries of the catalog on tables of a few rows, against their SQL."""

import duckdb
import pytest
from graphs import make, props
from pyspark.sql import functions as F

from graphloom.model import PROP
from graphloom.operators import algebra, condense, linking
from graphloom.plans import catalog

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "NORTH")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "OSTLAND", 0), (1, "WESTMARK", 0)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(k, f"Customer#{k:09d}", k % 2, 100.0 * k, "BUILDING") for k in (1, 7, 20, 33, 40)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(1, "Supplier#000000001", 0, 5.0)]),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(1, "green ash", "B", "T", 1, 2.0)]),
    "orders": ("o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string", [(1, 1, 3.0, "O")]),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", [(1, 1, 1, 1)]),
}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def expected(small, query, columns):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet/*.parquet'")
    return sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[query]})").fetchall())


def test_merge_props_takes_every_message(spark, small):
    found = catalog.queries()["merge_props"](spark, small)
    got = sorted(map(tuple, found.collect()))
    assert got == expected(small, "merge_props", found.columns)
    # each customer's message drops the last character of its name
    names = {i: p.split("name=")[1].split(";")[0] for i, p in got}
    assert all(names[k * 8 + 2] == f"Customer#{k:09d}"[:-1] for k in (1, 7, 20, 33, 40))


def test_node_similarity_sends_no_side_of_its_pairs_through_the_driver(spark, small):
    found = catalog.queries()["node_similarity"](spark, small)
    q, _ = catalog.query_graph(spark, small, catalog.QUERY_SHARE)
    plan = linking.similarity_table(q, catalog.stored(spark, small)[0])._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(map(tuple, found.collect())) == expected(small, "node_similarity", found.columns)


def test_block_pairs_once_and_asks_little_of_a_pair(spark):
    """Nodes with several common labels, in any order, are one pair; no set of labels is made for each pair."""
    rows = [["A", "B"], ["B", "A"], ["C"], ["B", "C"], ["D"], []]
    props = f"MAP<STRING, {PROP}>"
    q = spark.createDataFrame([(1, 1, i, x, {}) for i, x in enumerate(rows)], f"msg_id long, gid long, q_id long, labels array<string>, props {props}")
    d = spark.createDataFrame([(1, i, x, {}) for i, x in enumerate(rows)], f"gid long, id long, labels array<string>, props {props}")
    met = linking.block(q, d)
    assert "array_intersect" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.q_id, r.d_id) for r in met.collect()) == [(i, j) for i, x in enumerate(rows) for j, y in enumerate(rows) if set(x) & set(y)]


def test_a_closure_is_extended_through_the_nearest_added_pairs(spark, monkeypatch):
    """A path of 40 nodes, and the same back, is met once at each step: what the joins are given are rows to one start and from one end."""
    held = {}
    once = condense.cut
    monkeypatch.setattr(condense, "cut", lambda df, name: held.setdefault(name, once(df, name)))
    known = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40)], "src long, dst long")
    added = spark.createDataFrame([(i + 1, i) for i in range(0, 40, 4)], "src long, dst long")
    got = {(r.src, r.dst) for r in condense.extend_closure(known, added).collect()}
    assert got == {p for k in range(0, 40, 4) for p in ((k, k), (k + 1, k), (k + 1, k + 1))}
    into = held["extend-into"].collect()
    assert len(into) == len({r.src for r in into}) == 37  # all nodes that a start lies behind


def test_neighbours_are_counted_from_one_count_of_pairs(spark):
    """Edges are read for their ids and to count pairs; degrees come from these counts, whose shuffle is used again."""
    _, e = make(spark, [], [(1, "x", 2), (2, "x", 1), (2, "y", 3), (3, "y", 3), (3, "y", 4)])
    e = e.unionByName(spark.createDataFrame([("none", None, None, "y"), ("half", 4, None, "y")], e.schema))
    found = algebra.neighbour_counts(e.where("type <> 'z'"))
    assert {r.edge_id.split("|")[-1]: r.n for r in found.collect()} == {"0": 2, "1": 2, "2": 4, "3": 2, "4": 3, "half": 1}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan ExistingRDD") == 2 * 2 and "ReusedExchange" in plan


def test_pairs_are_scored_alike_by_columns(spark):
    """Compiled columns give what the properties themselves give: numbers, texts, booleans, lists, kinds that clash, and nodes that have nothing yet."""
    rows = [({"n": 1, "t": "abc", "b": True}, {"n": 3, "t": "abd", "b": False}), ({"t": "abc"}, {"t": ["abd", "x"]}), ({"t": "abc"}, {"t": 4}), ({"t": ""}, {"t": ""}), ({"n": 1}, {"t": "a"}), ({"_k": 1, "n": 2}, {"_k": 5, "n": 2}), ({"n": 2}, {})]
    both = props(spark, rows)
    q = both.select("msg_id", "gid", "q_id", F.array(F.lit("A")).alias("labels"), F.col("q_props").alias("props"))
    d = both.select("gid", "d_id", F.col("d_props").alias("props"))
    got = linking._scored([(both.select("msg_id", "gid", "q_id", "d_id"), d.where("size(props) > 0"), ["gid", "d_id"])], q, d, 0.1)
    key = lambda df: {r.q_id: r.sim for r in df.collect()}
    assert key(got) == key(linking.similarity(both, 0.1)) and len(key(got)) == len(rows)
