"""Profiles of relation types: frequency, domain and range, and a view config inferred from them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.config import Rel, ViewConfig


def rel_frequency(le: DataFrame, start: str, rel: str, end: str) -> DataFrame:
    """``(frequency)``: of the edges from a start label to an end label, the share of one type; 0 when there are none."""
    between = le.where(F.array_contains("src_labels", start) & F.array_contains("dst_labels", end))
    return between.agg(F.coalesce(F.try_divide(F.count_if(F.col("type") == rel), F.count(F.lit(1))), F.lit(0.0)).cast("double").alias("frequency"))


def rel_frequencies(le: DataFrame) -> DataFrame:
    """``(start, rel, end, n, frequency)`` of all combinations of labels and type that occur."""
    rows = le.select(F.explode("src_labels").alias("start"), "dst_labels", "type").select("start", F.explode("dst_labels").alias("end"), "type")
    counts = rows.groupBy("start", "end", "type").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("start", "end").agg(F.sum("n").alias("total"))
    return counts.join(totals, ["start", "end"]).select("start", F.col("type").alias("rel"), "end", "n", (F.col("n") / F.col("total")).alias("frequency"))


def domain_range(le: DataFrame) -> DataFrame:
    """``(type, domain, range)``: all labels of start and of end nodes, sorted. Equal label sets are folded before they are gathered."""
    sets = le.select("type", "src_labels", "dst_labels").distinct()
    labels = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return sets.groupBy("type").agg(labels("src_labels").alias("domain"), labels("dst_labels").alias("range"))


def rel_types(edges: DataFrame, type_col: str = "type", limit: int | None = None, skip: int = 0) -> DataFrame:
    """Distinct types; with a limit, those of so many edges in the order of their ids after ``skip``."""
    rows = edges if limit is None and not skip else edges.orderBy("edge_id").offset(skip).limit(limit if limit is not None else 2**31 - 1)
    return rows.select(F.col(type_col).alias("type")).distinct()


def infer_view_config(le: DataFrame) -> ViewConfig:
    """A config with every type and all labels of its ends; there are as many rows as types."""
    rows = domain_range(le).orderBy("type").collect()
    labels = sorted({x for r in rows for x in (*r.domain, *r.range)})
    return ViewConfig(tuple(labels), tuple(Rel(r.type, tuple(r.domain), tuple(r.range)) for r in rows))
