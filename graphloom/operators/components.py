"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import drop_path, written

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """Per ``u`` its least neighbour, combined before the shuffle, so a hub costs one row per task."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", name: str = "components") -> DataFrame:
    """``(id, component)`` of every node of the edges; the component is its least node. Rows with a null end are left out.

    Each round is written to the shared folder, so a lost executor costs a read; the round before is dropped. A component is
    never gathered in one place: aggregates are combined before the shuffle and joins have one row per key on one side.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes, nodes_path = written(pairs.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), f"{name}-edges")
    current, old_path = nodes.where("u <> v"), None
    before = _mark(current)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        current, path = written(_small_star(_large_star(current)).where("u <> v").distinct(), name)
        if old_path:
            drop_path(current.sparkSession, old_path)
        old_path = path
        now = _mark(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # every node is a root, or has an edge to its root
    roots = current.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    inside = current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    loops = nodes.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("component"))
    return inside.unionByName(loops).groupBy("id").agg(F.min("component").alias("component"))
