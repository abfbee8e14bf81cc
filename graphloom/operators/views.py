"""View generation: nodes by label, relations by type and end labels, virtual relations of two hops, closures."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import has_any, label_edges
from graphloom.operators.closure import closure_delta
from graphloom.plans.config import Hop, Rel, ViewConfig, VRel, new_vrels, ordered
from graphloom.sources.tables import cut

TILE = 1024  # rows of a tile of a hub's pairs, each way


def select_nodes(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Nodes with any of the labels."""
    return nodes.where(has_any(F.col("labels"), labels))


def copy_view_nodes(nodes: DataFrame, labels: list[str], chain: bool = False) -> DataFrame:
    """Selected nodes with all labels and properties, and ``realId``: their own id, or with ``chain`` the realId they already have."""
    real = F.coalesce(F.col("realId"), F.col("id")) if chain and "realId" in nodes.columns else F.col("id")
    return select_nodes(nodes, labels).withColumn("realId", real)


def ends_match(start_labels, end_labels) -> Column:
    return has_any(F.col("src_labels"), list(start_labels)) & has_any(F.col("dst_labels"), list(end_labels))


def extract_rels(le: DataFrame, rel_type: str, start_labels: list[str], end_labels: list[str]) -> DataFrame:
    """Distinct ``(src, dst)`` of a type whose start has any start label and whose end has any end label."""
    return le.where((F.col("type") == rel_type) & ends_match(start_labels, end_labels)).select("src", "dst").distinct()


def view_rels(le: DataFrame, view_nodes: DataFrame, rels: list[Rel], strict: bool = False) -> DataFrame:
    """``(conf, src, dst, type)`` of all configured relations in one pass over the edges, both ends in the view.

    With ``strict`` an end outside the view is an error, not a dropped row.
    """
    if not rels:
        return le.select(F.lit(0).alias("conf"), "src", "dst", "type").limit(0)
    tags = F.array_compact(F.array(*(F.when((F.col("type") == r.type) & ends_match(r.start_labels, r.end_labels), F.lit(i)) for i, r in enumerate(rels))))
    found = le.where(F.col("type").isin(sorted({r.type for r in rels}))).select("src", "dst", "type", F.explode(tags).alias("conf")).select("conf", "src", "dst", "type").distinct()
    ids = view_nodes.select(F.col("realId").alias("id"))
    inside = found.join(ids, found["src"] == ids["id"], "left_semi").join(ids, F.col("dst") == ids["id"], "left_semi")
    if strict and found.count() != inside.count():
        raise ValueError("a relation has an end outside the view")
    return inside


def _side(le: DataFrame, hop: Hop, near: str, far: str) -> DataFrame:
    """Edges of a hop by middle and far node: their number and the least edge id of each pair of nodes."""
    labelled = le.where((F.col("type") == hop.type) & ends_match([hop.start_label], [hop.end_label]))
    return labelled.groupBy(F.col(near).alias("mid"), F.col(far).alias("end")).agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("edge"))


def _ends(le: DataFrame, hop: Hop, near: str, far: str) -> DataFrame:
    """Distinct pairs of middle and far node of a hop."""
    labelled = le.where((F.col("type") == hop.type) & ends_match([hop.start_label], [hop.end_label]))
    return labelled.select(F.col(near).alias("mid"), F.col(far).alias("end")).distinct()


def _hop_ends(first: Hop, second: Hop) -> tuple[tuple[str, str], tuple[str, str]]:
    """The columns of the middle and of the far node of each hop. Path n0 - n1 - n2: the first hop goes n0 to n1 along its edge (against
    it if inverse), the second n1 to n2."""
    return ("src", "dst") if first.inverse else ("dst", "src"), ("dst", "src") if second.inverse else ("src", "dst")


def two_sides(le: DataFrame, first: Hop, second: Hop) -> tuple[DataFrame, DataFrame]:
    """Both hops by middle node, see :func:`_hop_ends`."""
    one, two = _hop_ends(first, second)
    return _side(le, first, *one), _side(le, second, *two)


def distinct_edges(a_n: str, a_edge: str, b_n: str, b_edge: str) -> Column:
    """Whether the two sides have two different edges: one edge cannot be both hops."""
    return ~((F.col(a_n) == 1) & (F.col(b_n) == 1) & (F.col(a_edge) == F.col(b_edge)))


def _by_paths(side: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a side whose far node has one middle node only, and the rows of the others. No row is moved for the first: its columns come with the count."""
    carried = [c for c in side.columns if c not in (end, "mid")]
    met = side.groupBy(end).agg(F.count(F.lit(1)).alias("mids"), F.min("mid").alias("mid"), *(F.min(c).alias(c) for c in carried))
    return met.where("mids = 1").select(*side.columns), side.join(met.where("mids > 1").select(end), end, "left_semi").select(*side.columns)


def _tiles(one: DataFrame, two: DataFrame) -> DataFrame:
    """The pairs of rows of both sides with one middle node, with the columns of both. A middle node's pairs are a grid of tiles of about ``TILE``
    rows each way, each tile a row of two arrays until it is unfolded: so a hub is spread over all tasks, what is moved is a small part of the
    pairs, and rows come in runs of one start that repeat the same ends, which any columnar file packs well."""
    tasks = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda side, name: side.groupBy("mid").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(name))
    rows = count(one, "rows")
    grid = count(two.join(rows, "mid", "left_semi"), "columns").join(rows, "mid")

    def dealt(side: DataFrame, end: str, own: str, other: str, name: str) -> DataFrame:
        place = F.pmod(F.xxhash64(end), F.col(own)).cast("int").alias(own[:-1])
        held = F.collect_list(F.struct(*(c for c in side.columns if c != "mid"))).alias(name)
        folded = side.join(grid, "mid").groupBy("mid", place, other).agg(held)
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1])
        return folded.select("mid", own[:-1], every, name).repartition(tasks, "mid", "row", "column")

    met = dealt(one, "src", "rows", "columns", "a").join(dealt(two, "dst", "columns", "rows", "b"), ["mid", "row", "column"])
    return met.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b")).select("a.*", "b.*")


def compose_vrel(le: DataFrame, vrel: VRel) -> DataFrame:
    """Distinct ``(src, dst)`` of two-hop paths through two different edges.

    Parallel edges are folded to one row per pair of nodes before the join; one edge can be both hops only where the ends are equal, and
    never where the hops differ in type: then no edge id is carried. The join is by the middle node; a hub's rows are split by the
    adaptive skew join. A start with a single middle node meets each end once, so only the pairs of starts that have several go
    through a shuffle to be made distinct: the pairs of a hub whose nodes belong to nothing else, of which there may be the square, never do
    (see :func:`_tiles`).
    """
    apart = vrel.first.type != vrel.second.type
    if apart:
        one, two = (_ends(le, hop, *ends) for hop, ends in zip((vrel.first, vrel.second), _hop_ends(vrel.first, vrel.second), strict=True))
        one, two = one.withColumnRenamed("end", "src"), two.withColumnRenamed("end", "dst")
    else:
        one, two = two_sides(le, vrel.first, vrel.second)
        one = one.select("mid", F.col("end").alias("src"), F.col("n").alias("n1"), F.col("edge").alias("e1"))
        two = two.select("mid", F.col("end").alias("dst"), F.col("n").alias("n2"), F.col("edge").alias("e2"))

    def met(rows: DataFrame) -> DataFrame:
        return (rows if apart else rows.where((F.col("src") != F.col("dst")) | distinct_edges("n1", "e1", "n2", "e2"))).select("src", "dst")

    lone, several = _by_paths(one, "src")
    return met(_tiles(lone, two)).unionByName(met(several.join(two, "mid")).distinct())


def _tagged(pairs: DataFrame, type_: str, provenance: str) -> DataFrame:
    return pairs.select("src", "dst", F.lit(type_).alias("type"), F.lit(provenance).alias("provenance"))


def _with_ids(edges: DataFrame) -> DataFrame:
    """Edge ids of view edges: one edge per (type, ends) and provenance."""
    return edges.withColumn("edge_id", F.concat_ws("|", "type", "provenance", "src", "dst")).select("edge_id", "src", "dst", "type", "provenance")


def expand(view_nodes: DataFrame, view_edges: DataFrame, vrels: tuple[VRel, ...]) -> DataFrame:
    """View edges with those of the virtual relations, level by level; a level sees what earlier ones made, with its closure."""
    nodes = view_nodes.select(F.col("realId").alias("id"), "labels")
    for level in ordered(vrels):
        le = cut(label_edges(nodes, view_edges), "view-labelled")
        made = []
        for v in level:
            pairs = compose_vrel(le, v)
            if v.symmetrical or v.transitive:
                pairs = cut(pairs, "view-vrel")
                made.append(_tagged(closure_delta(pairs, v.symmetrical, v.transitive), v.type, "vrel-closure"))
            made.append(_tagged(pairs, v.type, "vrel"))
        view_edges = view_edges.unionByName(_with_ids(reduce(DataFrame.unionByName, made).distinct()))
    return view_edges


def gen_view(nodes: DataFrame, edges: DataFrame, config: ViewConfig) -> tuple[DataFrame, DataFrame]:
    """``(view nodes, view edges)``; edges carry ``provenance``: rel, closure, vrel or vrel-closure."""
    view_nodes = copy_view_nodes(nodes, list(config.labels))
    rels = view_rels(label_edges(nodes, edges), view_nodes, list(config.rels))
    if any(r.symmetrical or r.transitive for r in config.rels):
        rels = cut(rels, "view-rels")
    parts = [rels.select("src", "dst", "type", F.lit("rel").alias("provenance")).distinct()]
    for i, r in enumerate(config.rels):
        if r.symmetrical or r.transitive:
            parts.append(_tagged(closure_delta(rels.where(F.col("conf") == i), r.symmetrical, r.transitive), r.type, "closure"))
    return view_nodes, expand(view_nodes, _with_ids(reduce(DataFrame.unionByName, parts)), config.vrels)


def expand_view(view_nodes: DataFrame, view_edges: DataFrame, last: ViewConfig, current: ViewConfig) -> DataFrame:
    """A stored view's edges with those of the virtual relations that are new; other changes of the config are ignored."""
    return expand(view_nodes, view_edges, new_vrels(last, current))


def type_allowlist_view(le: DataFrame, label: str, types: list[str]) -> DataFrame:
    """Distinct ``(src, dst, type)`` of listed types between nodes of one label."""
    return le.where(F.col("type").isin(types) & ends_match([label], [label])).select("src", "dst", "type").distinct()


def write_view(view_nodes: DataFrame, view_edges: DataFrame, path: str) -> None:
    """Nodes as Parquet, edges as Parquet by type."""
    view_nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    view_edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
