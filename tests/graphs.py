"""Small hand graphs with known answers."""

from pyspark.sql import functions as F

from graphloom.model import NODE_SCHEMA



def node(i, *labels):
    return (i, list(labels), {})


def make(spark, nodes, edges):
    n = spark.createDataFrame(nodes, NODE_SCHEMA)
    e = spark.createDataFrame([(f"{t}|{a}|{b}|{i}", a, b, t) for i, (a, t, b) in enumerate(edges)], "edge_id string, src long, dst long, type string")
    return n, e


def companies(spark):
    """Companies 1, 2, 3 and persons 11, 12; founder: 1-11, 2-11, 2-12, 3-12."""
    nodes = [node(i, "Company") for i in (1, 2, 3)] + [node(i, "Person") for i in (11, 12)]
    return make(spark, nodes, [(1, "founder", 11), (2, "founder", 11), (2, "founder", 12), (3, "founder", 12)])


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


def props(spark, rows):
    """One row per case: {name: python value} on two sides, as property maps."""

    def value(v):
        none = {"kind": None, "num": None, "str": None, "bool": None}
        if isinstance(v, bool):
            return none | {"kind": "bool", "bool": v, "arr": None}
        if isinstance(v, (int, float)):
            return none | {"kind": "num", "num": float(v), "arr": None}
        if isinstance(v, str):
            return none | {"kind": "str", "str": v, "arr": None}
        return none | {"kind": "list", "arr": [{k: x for k, x in value(i).items() if k != "arr"} for i in v]}

    data = [(i, {k: value(v) for k, v in a.items()}, {k: value(v) for k, v in b.items()}) for i, (a, b) in enumerate(rows)]
    from graphloom.model import PROP

    return spark.createDataFrame(data, f"q_id long, q_props MAP<STRING, {PROP}>, d_props MAP<STRING, {PROP}>").withColumns({"msg_id": F.lit(1).cast("long"), "gid": F.lit(1).cast("long"), "d_id": F.col("q_id")})


