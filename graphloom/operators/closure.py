"""Closures of pair tables ``(src, dst)``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.sources.tables import written

MAX_ITER = 200
MAX_PAIRS = 10_000_000_000


def symmetric_closure(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def transitive_closure(pairs: DataFrame, max_iter: int = MAX_ITER, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """All ``(a, b)`` with a path from a to b; ``(a, a)`` on cycles. By doubling, so the rounds are about the logarithm of the longest shortest path.

    After a round all pairs at a distance of ``n`` edges or less are known, and those at exactly ``n`` are marked as ``far``. A pair farther off,
    up to twice ``n``, has a shortest path whose first ``n`` edges are a far pair and whose rest is known: a round joins the far pairs alone with all that
    are known, so a pair is met once for each node at that place of a shortest path (once in a tree), and not once for each way to split it. Where no
    pair is at ``n``, none is farther. A round's new pairs are written to the shared folder; what is known is all these parts, and none is written twice.
    """
    base = pairs.select("src", "dst").where("src is not null and dst is not null").distinct()
    new, path = written(base.withColumn("far", F.lit(True)), "closure")
    spark, known, parts = new.sparkSession, new, [path]
    total, far = new.agg(F.count(F.lit(1)), F.count_if("far")).first()
    for _ in range(max_iter):
        if far == 0:
            return known.select("src", "dst")
        front = new.where("far").select("src", F.col("dst").alias("mid"))
        met = front.join(known.select(F.col("src").alias("mid"), "dst", "far"), "mid")
        fresh = met.groupBy("src", "dst").agg(F.bool_and("far").alias("far")).join(known.select("src", "dst"), ["src", "dst"], "left_anti")
        new, path = written(fresh.select("src", "dst", "far"), "closure-delta")
        n, far = new.agg(F.count(F.lit(1)), F.count_if("far")).first()
        total += n
        if total > max_pairs:
            raise RuntimeError(f"the closure has more than {max_pairs} pairs")
        near = spark.read.schema(new.schema).parquet(*parts).withColumn("far", F.lit(False))
        parts.append(path)
        known = near.unionByName(new)
    raise RuntimeError(f"the closure did not settle in {max_iter} rounds")


def equivalence_closure(pairs: DataFrame, emit: str = "pairs", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Symmetric and transitive closure: all ordered pairs within a connected component, ``(a, a)`` included.

    With ``emit='components'`` ``(id, component)`` instead, whose size is that of the nodes; pairs are refused beyond ``max_pairs``.
    """
    members = connected_components(pairs)
    if emit == "components":
        return members
    sizes = members.groupBy("component").count()
    pairs_ = sizes.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    if pairs_ > max_pairs:
        raise RuntimeError(f"the closure has {pairs_} pairs, more than {max_pairs}; use emit='components'")
    other = members.select(F.col("id").alias("dst"), "component")
    return members.select(F.col("id").alias("src"), "component").join(other, "component").select("src", "dst")


def closure_delta(pairs: DataFrame, symmetrical: bool, transitive: bool) -> DataFrame:
    """The closure less the pairs themselves; nothing without a flag."""
    base = pairs.select("src", "dst").distinct()
    if symmetrical and transitive:
        closed = equivalence_closure(base)
    elif symmetrical:
        closed = symmetric_closure(base)
    elif transitive:
        closed = transitive_closure(base)
    else:
        return base.limit(0)
    return closed.join(base, ["src", "dst"], "left_anti")
