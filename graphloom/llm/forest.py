"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

Every distinct shingle set has ``trees`` signatures of ``max_depth`` values. A tree is the sorted sequence of all its signatures, which is
its prefix trie; it is range-partitioned over the cluster. Along the sequence each set meets the first set of the trie node that it shares
with the one before it, at the depth of that node: a star per node, not pairs, and the stars down to any depth link what that
depth links. The longest matches say how alike the links of this corpus are; matched prefixes are shortened from there until the
least alike of them is found in some tree with the target recall. Within a connected group of stars all pairs are verified exactly, large
groups in blocks, by counting common shingles; only each set's number of links and a spanning edge leave the task.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import passages, phrases
from graphloom.llm.batches import small_batches, trimmed, trimmed_batches
from graphloom.operators.components import connected_components
from graphloom.sources.tables import cut

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
MAX_DEPTH = 8
MARGIN = 0.05  # below the threshold, at which a similarity told by signatures may still be a link's
RECALL = 0.9999
BLOCK = 1024  # sets of a large group compared as one block
CELL_BYTES = 8 << 20  # of shingles in such a block
TASK_BYTES = 16 << 20
RARE = 32
SEED = 20240229


def found_at(similarity: float, depth: int, trees: int = TREES) -> float:
    """How likely a pair shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(recall: float, similarity: float, trees: int = TREES, max_depth: int = MAX_DEPTH) -> int:
    """The longest prefix, shortening from ``max_depth``, that pairs of this similarity share in some tree with the recall."""
    for depth in range(max_depth, 0, -1):
        if found_at(similarity, depth, trees) >= recall:
            return depth
    raise ValueError("the target recall needs more trees")


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one behind the other; and their numbers. A text of fewer words is one
    shingle, one without words has none."""
    h, counts = phrases.word_units(texts)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        grams = passages._grams(h, size) if len(h) >= size else np.zeros(0, np.uint64)
        out = []
        for a, b in zip(ends - counts, ends, strict=True):
            if b - a >= size:
                out.append(np.unique(grams[a : b - size + 1]))
            else:
                out.append(passages._grams(h[a:b], int(b - a)) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array([len(x) for x in out], np.int64)


def signatures(flat: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """uint16 [sets, n]: minima under ``n`` hash functions, folded to two bytes. Sets must not be empty."""
    rng = np.random.default_rng(SEED)
    a = (rng.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    b = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), n), np.uint16)
    x = (flat >> np.uint64(32)).astype(np.uint32)
    lo = 0
    while lo < len(counts):  # pieces that stay in cache
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 15))))
        part = x[starts[lo] : starts[hi] if hi < len(counts) else len(x)]
        at = starts[lo:hi] - starts[lo]
        work = np.empty_like(part)
        for i in range(n):
            np.multiply(part, a[i], out=work)
            np.bitwise_xor(work, b[i], out=work)
            low = np.minimum.reduceat(work, at) * np.uint32(0x9E3779B1)
            out[lo:hi, i] = low >> np.uint32(16)
        lo = hi
    return out


def _set_hashes(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; zero for an empty one."""
    some = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[some]
    out = np.zeros((2, len(counts)), np.uint64)
    with np.errstate(over="ignore"):
        for i, x in enumerate((flat, passages.mix(flat + passages.MULT))):
            if len(some):
                out[i, some] = passages.mix(np.add.reduceat(x, starts) + passages.MIX)
    return out[0].view(np.int64), out[1].view(np.int64)


def _chunks(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Whole texts of a batch, some MB at a time, with the place of the first."""
    start, held, size = 0, [], 0
    for i, x in enumerate(batch.column(text)):
        raw = x.as_py().encode() if x.is_valid else b""
        if held and size + len(raw) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def _local_roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component representative of each of ``m`` nodes under links (a, b), by repeated minimum and jumping."""
    root = np.arange(m)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of sets with a Jaccard similarity of at least the threshold; with two sides, only pairs across them."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    x, row = flat[order], row[order]
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    n = np.diff(np.concatenate([at, [len(x)]]))
    code, count = [], []
    for width in range(2, RARE + 1):  # shingles of few sets: their pairs
        some = at[n == width]
        if len(some):
            members = row[some[:, None] + np.arange(width)]
            i, j = np.triu_indices(width, 1)
            for lo in range(0, len(members), 1 << 14):
                part = members[lo : lo + (1 << 14)]
                c, k = np.unique((part[:, i] * m + part[:, j]).ravel(), return_counts=True)
                code.append(c)
                count.append(k)
    common = np.zeros(0, np.float32)
    wide = np.flatnonzero(n > RARE)
    dense = None
    if len(wide):  # shingles of many sets: a matrix product
        dense = np.zeros((m, m), np.float32)
        for lo in range(0, len(wide), 4096):
            cols = wide[lo : lo + 4096]
            block = np.zeros((m, len(cols)), np.float32)
            block[row[np.repeat(at[cols] - (np.cumsum(n[cols]) - n[cols]), n[cols]) + np.arange(n[cols].sum())], np.repeat(np.arange(len(cols)), n[cols])] = 1
            dense += block @ block.T
    if dense is not None:
        for c, k in zip(code, count, strict=True):
            dense.ravel()[c] += k
        i, j = np.nonzero(np.triu(dense, 1))
        common = dense[i, j]
    elif code:
        c, inverse = np.unique(np.concatenate(code), return_inverse=True)
        common = np.bincount(inverse, np.concatenate(count))
        i, j = c // m, c % m
    else:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    common = common.astype(np.int64)
    ok = (common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9) & ((side[i] != side[j]) | (side.max() == side.min()))
    return i[ok], j[ok]


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL, trees: int = TREES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of ``docs``: its id, ``class_id`` (the least id among the documents that links reach), ``n_links`` (other
    documents whose sets of ``size``-word shingles have a Jaccard similarity of at least ``threshold`` with its own, copies included),
    ``n_shingles``, and ``kept`` (whether it stands for its class; of rows that repeat the least id, all do).

    ``recall``: how likely a link as little alike as any of this corpus is found (the same in every row), at least the one asked for.

    Words are runs of other characters than space and U+0009 to U+000D, unchanged. A text without words (null, empty) links with nothing
    and is its own class. A null id takes part, but is never a class id unless no other id is in the class. Repeated rows and ties are
    copies of one another. An empty table gives an empty one; other columns do not matter.
    """
    small_batches(docs.sparkSession)
    least = depth_for(recall, threshold, trees, max_depth)
    span = 1 + 2 * max_depth

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _chunks(batch, "text"):
                flat, counts = shingle_sets(texts, size)
                h1, h2 = _set_hashes(flat, counts)
                some = np.flatnonzero(counts)
                keys = np.empty((len(some), trees, span), np.uint8)
                keys[:, :, 0] = np.arange(trees)
                if len(some):
                    keys[:, :, 1:] = signatures(flat, counts[some], trees * max_depth).astype(">u2").view(np.uint8).reshape(len(some), trees, 2 * max_depth)
                values = pa.Array.from_buffers(pa.binary(), keys.shape[0] * trees, [None, pa.py_buffer(np.arange(keys.shape[0] * trees + 1, dtype=np.int32) * span), pa.py_buffer(keys.tobytes())])
                filled = np.zeros(len(counts) + 1, np.int32)
                filled[some + 1] = trees
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(filled), pa.int32()), values)
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("id"), pa.array(h1), pa.array(h2), pa.array(counts), lists], ["row", "id", "h1", "h2", "n", "keys"])

    # rows are numbered and written, so that texts are found again by number: ids may be null or repeat
    source = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "forest-rows")
    signed = cut(source.mapInArrow(trimmed_batches(sign), "row long, id long, h1 long, h2 long, n long, keys array<binary>"), "forest-signatures")
    sets = cut(signed.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("row").alias("row"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")), "forest-sets")
    stars = cut(_trie_edges(sets.select(F.explode("keys").alias("key"), F.col("h1").alias("node")), span, least), "forest-edges")
    alike = _least_alike(stars.where(F.col("depth") >= max_depth), sets, threshold)
    depth = depth_for(recall, alike, trees, max_depth)
    candidates = connected_components(stars.where(F.col("depth") >= depth), name="forest-candidates")
    links = cut(_verify(source, sets.drop("keys"), candidates, threshold, size), "forest-links")
    classes = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")), name="forest-classes").select(F.col("id").alias("h1"), "component")
    totals = links.groupBy(F.col("node").alias("h1"), F.col("node2").alias("h2")).agg(F.sum("links").alias("links"))
    placed = sets.drop("keys").join(classes, "h1").join(totals, ["h1", "h2"])
    least = placed.groupBy("component").agg(F.min("rep").alias("class_id"))
    found = placed.join(least, "component").select("h1", "h2", "n", "class_id", "links")
    own = sets.select("h1", "h2", "n", "rep", "copies")
    joined = signed.drop("keys", "row").join(own, ["h1", "h2", "n"], "left").join(found, ["h1", "h2", "n"], "left")
    class_id = F.coalesce("class_id", "rep", "id")
    return joined.select(F.col("id").alias(id_col), class_id.alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), F.col("n").alias("n_shingles"), class_id.eqNullSafe(F.col("id")).alias("kept"), F.lit(found_at(alike, depth, trees)).alias("recall"))


def _trie_edges(rows: DataFrame, span: int, least: int) -> DataFrame:
    """``(src, dst, depth)``: stars of the trie nodes of at least ``least`` values that hold two sets or more. ``rows``: (key: tree and
    signature, node)."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most = (span - 1) // 2
    names = ["src", "dst", "depth", "edge"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heads, rims = None, {}, []  # the head of the open trie node at each depth

        def rim() -> None:
            rims.extend((heads[d], d, last[0, : 1 + 2 * d].tobytes()) for d in heads)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, node = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(-1, span), batch.column("node").to_numpy()
            before = np.concatenate([keys[:1] if last is None else last, keys[:-1]])
            same = keys == before
            shared = np.logical_and.accumulate(same[:, 1::2] & same[:, 2::2], axis=1).sum(1) * same[:, 0]
            shared[0] *= last is not None
            first, last = last is None, keys[-1:].copy()
            at = np.arange(len(keys))
            for d in range(least, most + 1):
                start = np.maximum.accumulate(np.where(shared < d, at, -1))
                head = np.where(start >= 0, node[np.maximum(start, 0)], heads.get(d, 0))
                far = (shared == d) & (head != node)
                if far.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(head[far]), pa.array(np.full(far.sum(), d, np.int32)), pa.nulls(int(far.sum()), pa.binary())], names)
                heads[d] = int(head[-1])
            if first:
                rims += [(int(node[0]), d, keys[0, : 1 + 2 * d].tobytes()) for d in heads]
        if last is not None:
            rim()
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rims]), pa.array([x[0] for x in rims]), pa.array([x[1] for x in rims], pa.int32()), pa.array([x[2] for x in rims], pa.binary())], names)

    # the node is part of the range key, so a trie node that holds a third of all sets spans partitions; its parts meet by their prefix
    stars = cut(rows.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node").mapInArrow(trimmed_batches(runs), "src long, dst long, depth int, edge binary"), "forest-stars")
    rims = stars.where("edge is not null").select("src", "depth", "edge")
    across = rims.join(rims.groupBy("edge").agg(F.min("src").alias("dst")), "edge").select("src", "dst", "depth")
    return stars.where("edge is null").select("src", "dst", "depth").unionByName(across).where("src <> dst").groupBy("src", "dst").agg(F.max("depth").alias("depth"))


def _least_alike(longest: DataFrame, sets: DataFrame, threshold: float) -> float:
    """The least similarity, as signatures tell it, of the longest matches that can be links; the threshold if there are none. Whatever
    is as alike as the threshold has a good chance of being among the longest matches, so if any such pairs are there, they show."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                u, v = (np.frombuffer(b"".join(z), np.uint8).reshape(len(z), -1)[:, 1:].reshape(-1, 2) for z in (x, y))
                told.append(float((u == v).all(1).mean()))
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.float64())], ["alike"])

    side = lambda end, name: sets.select(F.col("h1").alias(end), F.col("keys").alias(name))
    met = longest.select("src", "dst").join(side("src", "a"), "src").join(side("dst", "b"), "dst").select("a", "b").mapInArrow(compare, "alike double")
    low = met.where(F.col("alike") >= threshold - MARGIN).agg(F.min("alike")).first()[0]
    return threshold if low is None else min(1.0, max(threshold, low - MARGIN))


def _verify(source: DataFrame, sets: DataFrame, candidates: DataFrame, threshold: float, size: int) -> DataFrame:
    """Per set and task: its links (in documents) and the root of its linked group. ``candidates``: (id, component)."""
    members = cut(sets.join(candidates.withColumnRenamed("id", "h1"), "h1"), "forest-members")
    groups = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * 8).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("bytes") / CELL_BYTES)).cast("int")
    planned = cut(members.join(groups, "component").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int")), "forest-plan")
    total = planned.agg(F.sum(F.col("n") * 8 * F.col("blocks"))).first()[0] or 0
    tasks = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _chunks(batch, "text"):
                flat, counts = shingle_sets(texts, size)
                part = batch.slice(start, len(texts))
                ends = np.cumsum(counts)
                raw = [flat[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("h1", "h2", "copies", "component", "blocks", "block")), pa.array(raw, pa.binary())], ["h1", "h2", "copies", "component", "blocks", "block", "shingles"])

    def compare(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_numpy() for c in ("h1", "h2", "copies", "component", "low", "high", "block")}
        raw = table.column("shingles")
        order = np.lexsort((cols["h2"], cols["h1"], cols["high"], cols["low"], cols["component"]))
        c = {k: v[order] for k, v in cols.items()}
        fresh = np.ones(len(order), bool)
        same = (c["component"][1:] == c["component"][:-1]) & (c["low"][1:] == c["low"][:-1]) & (c["high"][1:] == c["high"][:-1])
        fresh[1:] = ~same
        at = np.flatnonzero(fresh)
        out = []
        for lo, hi in zip(at, [*at[1:], len(order)], strict=True):
            pick = np.arange(lo, hi)
            crossed = c["low"][lo] != c["high"][lo]
            if crossed and (c["block"][pick] == c["block"][lo]).all():
                continue  # the other block has no sets
            i, j = linked_pairs([np.frombuffer(raw[int(order[x])].as_py(), np.uint64) for x in pick], c["block"][pick] if crossed else np.zeros(len(pick), int), threshold)
            if len(i):
                weight = np.bincount(i, c["copies"][pick][j], len(pick)) + np.bincount(j, c["copies"][pick][i], len(pick))
                root = _local_roots(len(pick), i, j)
                some = np.flatnonzero(weight)
                out.append((c["h1"][pick][some], c["h2"][pick][some], c["h1"][pick][root[some]], weight[some].astype(np.int64)))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("node", "node2", "root", "links"), parts, strict=True)))

    wanted = planned.select("row", "h1", "h2", "copies", "component", "blocks", "block")
    # a sort-merge join whatever the size of ``wanted``, so that cost grows in proportion
    texts = source.join(wanted.hint("merge"), "row").select("text", "h1", "h2", "copies", "component", "blocks", "block")
    filled = texts.mapInArrow(trimmed_batches(shingles), "h1 long, h2 long, copies long, component long, blocks int, block int, shingles binary")
    spread = filled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    cells = spread.withColumn("task", F.pmod(F.xxhash64("component", "low", "high"), F.lit(tasks)))
    return cells.groupBy("task").applyInArrow(trimmed(compare), "node long, node2 long, root long, links long")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
