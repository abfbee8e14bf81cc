"""A property graph over the tables of a sales schema. Ids are ``key * 8 + code`` of the table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import prop
from graphloom.sources.tables import sized

CODES = {"region": 0, "nation": 1, "customer": 2, "supplier": 3, "part": 4, "orders": 5}


def _id(table: str, key: str) -> Column:
    return F.col(key).cast("long") * 8 + CODES[table]


def _node(spark: SparkSession, sf_dir: str, table: str, key: str, labels: list[str], **props: tuple[str, str]) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    entries = [F.struct(F.lit(name), prop(kind, F.col(column))) for name, (kind, column) in props.items()]
    return rows.select(_id(table, key).alias("id"), F.array(*(F.lit(x) for x in labels)).alias("labels"), F.map_from_entries(F.array(*entries)).alias("props"))


def _sized(spark: SparkSession, sf_dir: str) -> None:
    sized(spark, *(f"{sf_dir}/{t}.parquet" for t in ("customer", "supplier", "part", "orders", "lineitem")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _sized(spark, sf_dir)
    parts = [
        _node(spark, sf_dir, "region", "r_regionkey", ["Region"], name=("str", "r_name")),
        _node(spark, sf_dir, "nation", "n_nationkey", ["Nation"], name=("str", "n_name")),
        _node(spark, sf_dir, "customer", "c_custkey", ["Customer", "Party"], name=("str", "c_name"), acctbal=("num", "c_acctbal"), segment=("str", "c_mktsegment")),
        _node(spark, sf_dir, "supplier", "s_suppkey", ["Supplier", "Party"], name=("str", "s_name"), acctbal=("num", "s_acctbal")),
        _node(spark, sf_dir, "part", "p_partkey", ["Part"], name=("str", "p_name"), brand=("str", "p_brand"), kind=("str", "p_type"), size=("num", "p_size"), price=("num", "p_retailprice")),
        _node(spark, sf_dir, "orders", "o_orderkey", ["Order"], name=("str", "o_orderkey"), price=("num", "o_totalprice"), status=("str", "o_orderstatus")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edge(rows: DataFrame, type_: str, src: Column, dst: Column, *keys: str) -> DataFrame:
    return rows.select(F.concat_ws("|", F.lit(type_), *(F.col(k).cast("string") for k in keys)).alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(type_).alias("type"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _sized(spark, sf_dir)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    items = read("lineitem")
    party = read("customer").select(_id("customer", "c_custkey").alias("id"), F.col("c_nationkey").alias("n")).unionByName(read("supplier").select(_id("supplier", "s_suppkey").alias("id"), F.col("s_nationkey").alias("n")))
    parts = [
        _edge(read("orders"), "PLACED", _id("customer", "o_custkey"), _id("orders", "o_orderkey"), "o_orderkey"),
        _edge(items.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct(), "CONTAINS", _id("orders", "l_orderkey"), _id("part", "l_partkey"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
        _edge(items.select("l_partkey", "l_suppkey").distinct(), "SUPPLIED_BY", _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "l_partkey", "l_suppkey"),
        _edge(party, "IN_NATION", F.col("id"), _id("nation", "n"), "id"),
        _edge(read("nation"), "IN_REGION", _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "n_nationkey"),
        _edge(read("part").where("p_partkey > 0"), "SUBST", _id("part", "p_partkey"), F.floor(F.col("p_partkey") / 2).cast("long") * 8 + CODES["part"], "p_partkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
