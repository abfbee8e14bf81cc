"""Graph algebra on node and edge tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import has_any
from graphloom.sources.tables import cut


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, out, in, bi)`` of every node; a self-loop counts twice in ``bi``."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    found = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.select("id").join(found, "id", "left").select("id", zero("o").alias("out"), zero("i").alias("in"), zero(F.coalesce("o", F.lit(0)) + F.coalesce("i", F.lit(0))).alias("bi"))


def neighbour_rels(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``(edge_id, neighbour)``: edges that share an end with each edge of ``of``, direction ignored, itself left out.

    Ends of ``of`` are matched with ends of all edges; an edge that meets at both ends is returned once.
    """
    ends = lambda e, name: e.select(F.col("edge_id").alias(name), F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    return ends(of, "edge_id").join(ends(edges, "neighbour"), "node").where("edge_id <> neighbour").select("edge_id", "neighbour").distinct()


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """``(edge_id, n)``: the number of neighbouring edges of every edge, from degrees and without the pairs.

    Edges that share both ends would be counted twice, so those of the same two nodes are taken off once.
    """
    # without rows that no join would keep: then all that reads the edges reads them alike, and Spark moves them once for all
    ordered = edges.select("edge_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a is not null and b is not null")
    twins = ordered.groupBy("a", "b").agg(F.count(F.lit(1)).alias("twins"))
    degree = twins.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node"), "twins").groupBy("node").agg(F.sum("twins").alias("d"))
    # what is joined with the degrees is one row per pair of nodes; edges, with their ids, are moved once, to their pair
    each = twins.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    n = F.when(F.col("a") == F.col("b"), F.col("da") - 1).otherwise(F.col("da") + F.col("db") - F.col("twins") - 1)
    return ordered.join(each.select("a", "b", n.cast("long").alias("n")), ["a", "b"]).select("edge_id", "n")


def reach_in_k(edges: DataFrame, pairs: DataFrame, k: int, directed: bool = False) -> DataFrame:
    """``(a, b, reach)``: whether b is at most ``k`` edges from a. A node reaches itself; a null or a node without edges reaches nothing else.

    Frontiers of both ends grow in turn, each from its distinct nodes only, and stop at nodes seen before. A pair leaves once it has met, and
    with it the frontiers and the nodes seen of ends that no other pair asks for.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    ahead = edges.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    back = ahead.select(F.col("y").alias("x"), F.col("x").alias("y"))
    if not directed:
        ahead = back = ahead.unionByName(back)
    ahead = ahead.where("x <> y").distinct()
    back = back.where("x <> y").distinct()
    asked = pairs.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    asked = cut(asked, "reach-asked")
    seen = {side: asked.select(F.col(side).alias("root")).distinct().withColumn("node", F.col("root")) for side in "ab"}
    front, waiting, found = dict(seen), asked, None
    for step in range(k):
        side, other, steps = ("a", "b", ahead) if step % 2 == 0 else ("b", "a", back)
        fresh = front[side].join(steps, F.col("node") == F.col("x")).select("root", F.col("y").alias("node")).distinct().join(seen[side], ["root", "node"], "left_anti")
        front[side] = cut(fresh, "reach-front")
        new = front[side].select(F.col("root").alias(side), "node")
        met = cut(waiting.join(new, side).join(seen[other].select(F.col("root").alias(other), "node"), [other, "node"], "left_semi").select("a", "b").distinct(), "reach-met")
        found = met if found is None else found.unionByName(met)
        waiting = cut(waiting.join(met, ["a", "b"], "left_anti"), "reach-waiting")
        if waiting.isEmpty():
            break
        seen[side] = seen[side].unionByName(front[side])
        for end in "ab":
            left = waiting.select(F.col(end).alias("root")).distinct()
            front[end], seen[end] = (x.join(left, "root", "left_semi") for x in (front[end], seen[end]))
    out = pairs.select("a", "b").join(found.withColumn("met", F.lit(True)), ["a", "b"], "left")
    return out.select("a", "b", (F.coalesce(F.col("a") == F.col("b"), F.lit(False)) | F.coalesce("met", F.lit(False))).alias("reach"))


def union_graphs(nodes_a: DataFrame, edges_a: DataFrame, nodes_b: DataFrame, edges_b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set union: nodes by id, edges by (src, type, dst); ends of edges that are in neither node table are added, without labels.

    Of rows with one id, a row of the first graph stays.
    """
    edges = edges_a.unionByName(edges_b).groupBy("src", "type", "dst").agg(F.min("edge_id").alias("edge_id")).select("edge_id", "src", "dst", "type")
    extra = nodes_b.join(nodes_a.select("id"), "id", "left_anti")
    nodes = nodes_a.dropDuplicates(["id"]).unionByName(extra.dropDuplicates(["id"]))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    bare = ends.join(nodes.select("id"), "id", "left_anti")
    empty = bare.select("id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema.fields if f.name != "id"))
    empty = empty.withColumn("labels", F.array().cast("array<string>")) if "labels" in nodes.columns else empty
    return nodes.unionByName(empty.select(*nodes.columns)), edges


def remove_rels(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the edges whose ids are in ``removed``, and without their ends that no edge keeps. Nodes that had no edge stay."""
    ids = removed.select("edge_id").distinct()
    kept = edges.join(ids, "edge_id", "left_anti")
    marked = edges.select("edge_id", "src", "dst").join(ids.withColumn("gone", F.lit(True)), "edge_id", "left")
    ends = marked.select(F.explode(F.array("src", "dst")).alias("id"), F.col("gone").isNull().alias("kept"))  # of both kinds in one pass
    orphans = ends.groupBy("id").agg(F.bool_or("kept").alias("kept")).where("NOT kept").select("id")
    return nodes.join(orphans, "id", "left_anti"), kept


def induced(nodes: DataFrame, le: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes with any of the labels, and the edges both of whose ends have any of them."""
    return nodes.where(has_any(F.col("labels"), labels)), le.where(has_any(F.col("src_labels"), labels) & has_any(F.col("dst_labels"), labels))


def list_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct node ids, and distinct (src, type, dst)."""
    return nodes.select("id").distinct(), edges.select("src", "type", "dst").distinct()

