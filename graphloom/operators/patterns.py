"""Two-hop patterns: existence of one or of many at once, their enumeration, and counts of type pairs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.views import distinct_edges, two_sides
from graphloom.plans.config import Hop, Rel

HOP = ["type", "start", "end", "inverse"]


def pattern_exists(le: DataFrame, first: Hop, second: Hop) -> bool:
    """Whether some path of two different edges matches."""
    one, two = two_sides(le, first, second)
    one = one.select("mid", F.col("end").alias("a"), F.col("n").alias("n1"), F.col("edge").alias("e1"))
    two = two.select("mid", F.col("end").alias("b"), F.col("n").alias("n2"), F.col("edge").alias("e2"))
    return not one.join(two, "mid").where((F.col("a") != F.col("b")) | distinct_edges("n1", "e1", "n2", "e2")).isEmpty()


def enumerate_patterns(spark, rels: list[Rel], new_types: set[str] | None = None) -> DataFrame:
    """Ordered pairs of (relation, orientation) whose labels at the middle agree; with ``new_types``, those with such a relation.

    A relation with several labels stands for each pair of them. The configs are few; their pairs are made by an equi-join.
    """
    rows = sorted({(r.type, s, e, inv) for r in rels for s in r.start_labels for e in r.end_labels for inv in (False, True)})
    hops = spark.createDataFrame(rows, "type string, start string, end string, inverse boolean")
    mid_after = F.when(F.col("inverse"), F.col("start")).otherwise(F.col("end"))
    mid_before = F.when(F.col("inverse"), F.col("end")).otherwise(F.col("start"))
    one = hops.select(*(F.col(c).alias(f"{c}1") for c in HOP), mid_after.alias("mid"))
    two = hops.select(*(F.col(c).alias(f"{c}2") for c in HOP), mid_before.alias("mid"))
    pairs = one.join(two, "mid").drop("mid")
    if new_types is not None:
        pairs = pairs.where(F.col("type1").isin(sorted(new_types)) | F.col("type2").isin(sorted(new_types)))
    return pairs.withColumn("pattern_id", F.concat_ws(" ", *(F.col(f"{c}{i}").cast("string") for i in (1, 2) for c in HOP)))


def prune_patterns(le: DataFrame, patterns: DataFrame) -> DataFrame:
    """``patterns`` with ``exists``, for all of them in one pass.

    Edges are counted per (middle node, relation with its labels, end that the node is of it): as many rows as nodes and such ends at most, never
    pairs of edges. The first hop against its edge and the second along it meet the node at the same end, so one count does for both. A
    node's signature is the set of these, each with its edge where there is just one; signatures repeat, and only distinct ones meet the patterns. A pattern exists at a node unless each side has exactly one edge there and it is the same. Patterns come from configs, so
    they are few; edges of other types are left out before they are given labels.
    """
    hop_id = lambda i: F.concat_ws(" ", *(F.col(f"{c}{i}").cast("string") for c in HOP))
    side = lambda i: patterns.select(*(F.col(f"{c}{i}").alias(c) for c in HOP), hop_id(i).alias("hop"), F.lit(i).alias("side")).distinct()
    hops = side(1).unionByName(side(2)).withColumn("at_start", (F.col("side") == 1) == F.col("inverse")).collect()
    if not hops:
        return patterns.withColumn("exists", F.lit(False))
    rels = {key: i for i, key in enumerate(sorted({(h.type, h.start, h.end) for h in hops}))}
    spark = le.sparkSession
    told = spark.createDataFrame([(rels[h.type, h.start, h.end], h.at_start, h.side, h.hop) for h in hops], "rel int, at_start boolean, side int, hop string")
    fits = F.array_compact(F.array(*(F.when((F.col("type") == t) & F.array_contains("src_labels", s) & F.array_contains("dst_labels", e), F.lit(i)) for (t, s, e), i in rels.items())))
    used = le.where(F.col("type").isin(sorted({t for t, _, _ in rels}))).select("edge_id", "src", "dst", F.explode(fits).alias("rel"))
    ends = F.explode(F.array(*(F.struct(F.lit(at).alias("at_start"), F.col("src" if at else "dst").alias("mid")) for at in sorted({h.at_start for h in hops}))))
    found = used.select("edge_id", "rel", ends.alias("x")).select("edge_id", "rel", "x.*")
    single = found.groupBy("rel", "at_start", "mid").agg(F.when(F.count(F.lit(1)) == 1, F.min("edge_id")).alias("only"))
    # an edge matters only where it is the single one at both ends of a pattern: as its place among these
    met = F.struct("rel", "at_start", "only")
    nodes = single.groupBy("mid").agg(F.array_sort(F.collect_set(met)).alias("met"))  # as many as there are hops
    edges = F.array_sort(F.array_distinct(F.filter(F.transform("met", lambda x: x["only"]), lambda e: e.isNotNull())))
    signature = F.transform("met", lambda x: F.struct(x["rel"].alias("rel"), x["at_start"].alias("at_start"), F.array_position(F.col("edges"), x["only"]).alias("only")))
    seen = nodes.withColumn("edges", edges).select(signature.alias("met")).distinct()
    each = lambda rows, i, *more: rows.select(*more, F.explode("met").alias("x")).select(*more, "x.*").join(told.where(F.col("side") == i), ["rel", "at_start"]).select(*more, F.col("hop").alias(f"hop{i}"), F.col("only").alias(f"only{i}"))
    both = each(each(seen, 1, "met"), 2, "met", "hop1", "only1").where("only1 is null or only2 is null or only1 <> only2").select("hop1", "hop2").distinct()
    tagged = patterns.select("pattern_id", hop_id(1).alias("hop1"), hop_id(2).alias("hop2"))
    held = tagged.join(both, ["hop1", "hop2"]).select("pattern_id").distinct()
    return patterns.join(held.withColumn("exists", F.lit(True)), "pattern_id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def two_hop_type_pairs(edges: DataFrame) -> DataFrame:
    """``(type1, type2, n)``: undirected two-hop paths of two different edges by their types, from degrees per node and type.

    A self-loop is seen once at its node. Only (node, type) rows are joined; the same edge as both hops is taken off.
    """
    both = edges.select("edge_id", "type", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    degrees = both.groupBy("node", "type").agg(F.count(F.lit(1)).alias("d"))
    per_node = degrees.groupBy("node").agg(F.collect_list(F.struct("type", "d")).alias("types"))  # as many as there are types
    pairs = per_node.select(F.explode("types").alias("a"), "types").select("a", F.explode("types").alias("b"))
    same = F.col("a.type") == F.col("b.type")
    walks = F.col("a.d") * F.col("b.d") - F.when(same, F.col("a.d")).otherwise(F.lit(0))
    return pairs.groupBy(F.col("a.type").alias("type1"), F.col("b.type").alias("type2")).agg(F.sum(walks).alias("n")).where("n > 0")
