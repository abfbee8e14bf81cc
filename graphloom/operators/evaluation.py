"""Scores of pattern decisions of two runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joint(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both runs, each with the patterns that the other has too."""
    return a.join(b.select("hash_code"), "hash_code", "left_semi"), b.join(a.select("hash_code"), "hash_code", "left_semi")


def joint_hashes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("hash_code").intersect(b.select("hash_code"))


def pattern_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def auto_ratio(logs: DataFrame) -> DataFrame:
    """``(auto_ratio)``: the share of rows decided automatically; null without rows."""
    return logs.agg(F.avg(F.col("pattern_type").contains("auto").cast("double")).alias("auto_ratio"))


def prune_metrics(logs: DataFrame) -> DataFrame:
    """``(tp, fp, fn, tn, accuracy, precision, recall)`` of pruning against manual decisions, null where there is nothing to divide.

    A row counts once: autoPruning as true positive, else manualMeaningless as false negative, else manualLabel as true negative. There
    are no false positives by definition.
    """
    has = lambda x: F.col("pattern_type").contains(x)
    kind = F.when(has("autoPruning"), "tp").when(has("manualMeaningless"), "fn").when(has("manualLabel"), "tn")
    counts = logs.select(kind.alias("k")).agg(*(F.count_if(F.col("k") == x).alias(x) for x in ("tp", "fn", "tn"))).withColumn("fp", F.lit(0).cast("long"))
    whole = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select("tp", "fp", "fn", "tn", F.try_divide(F.col("tp") + F.col("tn"), whole).alias("accuracy"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))
