"""Embedding near-dedup by an epsilon grid order join.

Vectors of unit length with a cosine of at least ``c`` are at most ``eps = sqrt(2 - 2c)`` apart, and so are their projections on any
orthogonal directions. They are sorted by the grid cells of width ``eps`` along the leading principal directions, lexicographically,
and cut into blocks of the sorted sequence. Pairs of intervals of the sequence, from the whole down to blocks, and within a task on to
leaves, are dropped as soon as their boxes are farther apart than ``eps``; what is left is compared in double precision.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.forest import _local_roots
from graphloom.operators.components import connected_components
from graphloom.sources.tables import cut

COSINE = 0.95
GRID_DIMS = 3
BOX_DIMS = 8
BLOCK = 4096
LEAF = 256
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def principal_directions(vectors: DataFrame, dim: int, keep: int) -> np.ndarray:
    """Leading eigenvectors [dim, keep] of the covariance, from sums of ``dim * (dim + 1) + 1`` numbers whatever the rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            if batch.num_rows:
                u = np.hstack([_unit(_matrix(batch, dim)), np.ones((batch.num_rows, 1))])
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((dim + 1) ** 2)), pa.array(total.ravel())], ["i", "x"])

    rows = vectors.select("vector").mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((dim + 1) ** 2)
    for r in rows:
        total[r.i] = r.x
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    return np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1][:, :keep]


def _apart(lo_a, hi_a, lo_b, hi_b):
    """Squared distance between boxes."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return (gap * gap).sum(-1)


def _leaves(a: int, b: int, boxes: list[np.ndarray], limit: float, same: bool, lo_a: int, lo_b: int, span: int) -> Iterator[tuple[int, int]]:
    """Pairs of leaves of two blocks whose boxes are near, by halving both intervals. ``boxes``: low and high of each, per leaf."""
    if lo_a >= a or lo_b >= b or (same and lo_b + span <= lo_a):
        return
    end_a, end_b = min(a, lo_a + span), min(b, lo_b + span)
    low_a, high_a, low_b, high_b = boxes
    if _apart(low_a[lo_a:end_a].min(0), high_a[lo_a:end_a].max(0), low_b[lo_b:end_b].min(0), high_b[lo_b:end_b].max(0)) > limit:
        return
    if span == 1:
        if not same or lo_a <= lo_b:
            yield lo_a, lo_b
        return
    half = span // 2
    for x in (lo_a, lo_a + half):
        for y in (lo_b, lo_b + half):
            yield from _leaves(a, b, boxes, limit, same, x, y, half)


def join_blocks(u: np.ndarray, v: np.ndarray, weight_u: np.ndarray, weight_v: np.ndarray, directions: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of both blocks (weighted by the other's copies), and a root of its linked group; rows of ``u`` first."""
    n, m = len(u), len(v)
    starts_u, starts_v = np.arange(0, n, LEAF), np.arange(0, m, LEAF)
    p, q = u @ directions, v @ directions
    boxes = [np.minimum.reduceat(p, starts_u), np.maximum.reduceat(p, starts_u), np.minimum.reduceat(q, starts_v), np.maximum.reduceat(q, starts_v)]
    links, root = np.zeros(n + m, np.int64), np.arange(n + m)
    span = 1
    while span < max(len(starts_u), len(starts_v)):
        span *= 2
    for x, y in _leaves(len(starts_u), len(starts_v), boxes, 2 - 2 * cosine + SLACK, same, 0, 0, span):
        a, b = slice(x * LEAF, min(n, (x + 1) * LEAF)), slice(y * LEAF, min(m, (y + 1) * LEAF))
        near = u[a] @ v[b].T >= cosine
        if same and x == y:
            near = np.triu(near, 1)
        if not near.any():
            continue
        links[a] += near @ weight_v[b]
        base = 0 if same else n
        links[base + b.start : base + b.stop] += near.T @ weight_u[a]
        i, j = np.nonzero(near)
        i, j = i + a.start, j + base + b.start
        while (root[i] != root[j]).any():  # join the groups of both ends; ``root`` is fully compressed, so only true roots get a parent
            x, y = root[i], root[j]
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root[root] != root).any():
                root = root[root]
    return links, root


def near_pairs(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: its id, ``n_links`` (other rows at a cosine of at least ``cosine``, copies included),
    ``component_id`` (the least id that links reach, its own included) and ``kept`` (whether that is its own).

    Null vectors, vectors of zeros, and those with a null or non-finite component link with nothing; so do those of another length
    than the most frequent one (the greater on a tie). A null id takes part, but is a component id only where no other is.
    """
    spark = vectors.sparkSession
    wide = "array<double>" if "double" in dict(vectors.dtypes)[vector_col] or "decimal" in dict(vectors.dtypes)[vector_col] else "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(wide).alias("vector"))
    good = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    common = rows.where(good).groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    rows = rows.withColumn("good", F.coalesce(good & (F.size("vector") == dim), F.lit(False))).withColumn("node", F.xxhash64("vector")).withColumn("node2", F.xxhash64(F.lit(1), "vector"))
    distinct = cut(rows.where("good").groupBy("node", "node2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "grid-vectors")
    plain = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not dim:
        return plain
    limit, eps = 2 - 2 * cosine + SLACK, float(np.sqrt(2 - 2 * cosine)) or 1.0
    directions = principal_directions(distinct, dim, min(dim, BOX_DIMS))
    boxes = directions.shape[1]
    grid = min(GRID_DIMS, boxes)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor(_unit(_matrix(batch, dim)) @ directions[:, :grid] / eps).astype(np.int32) if batch.num_rows else np.zeros((0, grid), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(at[:, i]) for i in range(grid))], [*batch.schema.names, *(f"c{i}" for i in range(grid))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def block(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            x = np.concatenate([_matrix(b, dim) for b in some])
            p = _unit(x) @ directions
            ints = [np.concatenate([b.column(c).to_numpy() for b in some]).astype(np.int64).tobytes() for c in ("node", "node2", "copies")]
            return pa.RecordBatch.from_arrays([pa.array([base | seq]), *(pa.array([float(v)]) for v in [*p.min(0), *p.max(0)]), *(pa.array([v], pa.binary()) for v in [*ints, x.astype(np.float64 if "double" in wide else np.float32).tobytes()])], names)

        names = ["block", *(f"lo{i}" for i in range(boxes)), *(f"hi{i}" for i in range(boxes)), "nodes", "nodes2", "copies", "vectors"]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - n)
                held.append(part)
                n += part.num_rows
                at += part.num_rows
                if n == BLOCK:
                    yield block(held)
                    seq, held, n = seq + 1, [], 0
        if n:
            yield block(held)

    order = [f"c{i}" for i in range(grid)]
    parts = max(1, int(distinct.agg(F.count(F.lit(1))).first()[0]) // (4 * BLOCK))
    sides = ", ".join(f"{s}{i} double" for s in ("lo", "hi") for i in range(boxes))
    celled = distinct.mapInArrow(cells, f"node long, node2 long, rep long, copies long, vector {wide}, " + ", ".join(f"c{i} int" for i in range(grid)))
    ordered = celled.repartitionByRange(parts, *order, "node", "node2").sortWithinPartitions(*order, "node", "node2")
    blocks = cut(ordered.mapInArrow(pack, f"block long, {sides}, nodes binary, nodes2 binary, copies binary, vectors binary"), "grid-blocks")
    # the sequence of blocks: one row per BLOCK vectors
    places = blocks.drop("nodes", "nodes2", "copies", "vectors").withColumn("place", F.row_number().over(Window.orderBy("block")) - 1)
    places = cut(places, "grid-places")
    count = places.count()
    pairs = _near_intervals(places, count, boxes, limit)
    left = blocks.select(F.col("block").alias("block_a"), *(F.col(c).alias(f"{c}_a") for c in ("nodes", "nodes2", "copies", "vectors")))
    right = blocks.select(F.col("block").alias("block_b"), *(F.col(c).alias(f"{c}_b") for c in ("nodes", "nodes2", "copies", "vectors")))
    met = pairs.join(left, "block_a").join(right, "block_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.float64 if "double" in wide else np.float32
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_py(), t)  # noqa: B023, E731
                same = batch.column("block_a")[r].as_py() == batch.column("block_b")[r].as_py()
                u, v = (_unit(get(f"vectors_{s}", kind).reshape(-1, dim)) for s in "ab")
                node, node2, copies = (np.concatenate([get(f"{c}_a", np.int64), get(f"{c}_b", np.int64)]) for c in ("nodes", "nodes2", "copies"))
                links, root = join_blocks(u, v, copies[: len(u)], copies[len(u) :], directions, cosine, same)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node2[some]), pa.array(node[root[some]]), pa.array(links[some])], ["node", "node2", "root", "links"])

    links = cut(met.mapInArrow(compare, "node long, node2 long, root long, links long"), "grid-links")
    classes = connected_components(links, "node", "root", name="grid-classes").select(F.col("id").alias("node"), "component")
    totals = links.groupBy("node", "node2").agg(F.sum("links").alias("links"))
    placed = distinct.drop("vector").join(classes, "node").join(totals, ["node", "node2"])
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = placed.join(least, "component").select("node", "node2", "component_id", "links")
    per = distinct.select("node", "node2", "rep", "copies").join(found, ["node", "node2"], "left")
    joined = rows.drop("vector").join(per.withColumn("good", F.lit(True)), ["node", "node2", "good"], "left")
    component = F.coalesce("component_id", "rep", "id")
    return joined.select(F.col("id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _near_intervals(places: DataFrame, count: int, boxes: int, limit: float) -> DataFrame:
    """Pairs of blocks (the first not behind the second) that are left when intervals of the sequence are halved down to blocks,
    each level dropping pairs whose boxes are farther apart than the limit."""
    levels = max(0, (count - 1).bit_length())
    pairs = places.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(levels - 1, -1, -1):
        own = F.shiftright(F.col("place"), level).cast("long")
        stats = places.groupBy(own.alias("x")).agg(*(F.min(f"lo{i}").alias(f"lo{i}") for i in range(boxes)), *(F.max(f"hi{i}").alias(f"hi{i}") for i in range(boxes)))
        halves = pairs.select(F.explode(F.array(*(F.struct((F.col("a") * 2 + i).alias("a"), (F.col("b") * 2 + j).alias("b")) for i in (0, 1) for j in (0, 1)))).alias("p")).select("p.a", "p.b").where("a <= b")
        first = stats.select(F.col("x").alias("a"), *(F.col(c).alias(f"{c}_a") for c in stats.columns[1:]))
        second = stats.select(F.col("x").alias("b"), *(F.col(c).alias(f"{c}_b") for c in stats.columns[1:]))
        gaps = [F.greatest(F.lit(0.0), F.col(f"lo{i}_a") - F.col(f"hi{i}_b"), F.col(f"lo{i}_b") - F.col(f"hi{i}_a")) for i in range(boxes)]
        pairs = halves.join(first, "a").join(second, "b").where(reduce(lambda x, y: x + y, (g * g for g in gaps)) <= limit).select("a", "b")
        if level % 2 == 0:
            pairs = cut(pairs, "grid-intervals")
    names = places.select("place", "block")
    return pairs.join(names.select(F.col("place").cast("long").alias("a"), F.col("block").alias("block_a")), "a").join(names.select(F.col("place").cast("long").alias("b"), F.col("block").alias("block_b")), "b").select("block_a", "block_b")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


# A plain all-pairs join in DuckDB, for comparison at small sizes.
OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS r FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
