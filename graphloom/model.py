"""The data model: nodes and edges as tables.

``nodes``: id BIGINT, labels ARRAY<STRING>, props MAP<STRING, PROP>; ``edges``: edge_id STRING, src BIGINT, dst BIGINT, type STRING.
A property value keeps its kind, as numbers, strings, booleans and lists are compared in different ways.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SINGLE = "STRUCT<kind: STRING, num: DOUBLE, str: STRING, bool: BOOLEAN>"
PROP = f"STRUCT<kind: STRING, num: DOUBLE, str: STRING, bool: BOOLEAN, arr: ARRAY<{SINGLE}>>"
NODE_SCHEMA = f"id BIGINT, labels ARRAY<STRING>, props MAP<STRING, {PROP}>"
EDGE_SCHEMA = "edge_id STRING, src BIGINT, dst BIGINT, type STRING"


def single(kind: str, value: Column) -> Column:
    """A single value as a struct of :data:`SINGLE`."""
    pick = lambda k, t: value.cast(t) if kind == k else F.lit(None).cast(t)
    return F.struct(F.lit(kind).alias("kind"), pick("num", "double").alias("num"), pick("str", "string").alias("str"), pick("bool", "boolean").alias("bool"))


def prop(kind: str, value: Column) -> Column:
    """A property value; for ``list`` the value is an array of :func:`single`."""
    base = single(kind, value) if kind != "list" else single("list", F.lit(None))
    arr = value if kind == "list" else F.lit(None)
    return F.struct(*(base[x].alias(x) for x in ("kind", "num", "str", "bool")), arr.cast(f"ARRAY<{SINGLE}>").alias("arr"))


def has_any(labels: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(labels, F.array(*(F.lit(x) for x in wanted))) if wanted else F.lit(False)


def label_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with ``src_labels`` and ``dst_labels``. Only ids and labels of the nodes are moved."""
    src = nodes.select(F.col("id").alias("src"), F.col("labels").alias("src_labels"))
    dst = nodes.select(F.col("id").alias("dst"), F.col("labels").alias("dst_labels"))
    return edges.join(src, "src").join(dst, "dst")


def long_props(nodes: DataFrame, key: str = "id") -> DataFrame:
    """``(key, prop, value)`` of every property of every node."""
    return nodes.select(key, F.explode("props").alias("prop", "value"))
