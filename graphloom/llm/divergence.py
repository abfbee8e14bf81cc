"""Audit of how far the sources of a language diverge, on run-length columns of term counts.

A task counts the terms of its documents by language and source and sends a row per distinct term. Terms that enough documents of
a language have are kept. The vocabulary is then reordered so that terms with equal counts lie together: terms with one vector of
counts are one row with a multiplicity, and within a shard these rows are sorted by columns, those with the fewest distinct counts
first. Each group's column is run-length encoded, a pair of groups meets at the union of its run boundaries, and the divergence of a
stretch is that of one term times the stretch's length. Everything is in whole numbers.

Nulls in text, language and source are empty texts. Rows that repeat each other are documents of their own. Equal values are
ordered by the item's UTF-8. A group without terms, and a language without a kept term, has its pairs with value 0 or by the smoothed
shares. An empty table gives an empty one. Long texts are read in slices that end between terms. Other columns are not looked at.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.batches import small_batches, trimmed, trimmed_batches
from graphloom.sources.tables import cut

MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lowered UTF-8
GAP = re.compile(rb"[^a-zA-Z\x80-\xff]")
SLICE = 4 << 20  # bytes of a text at a time, about
HELD = 400_000  # terms that a task holds before it sends them
BLOCK = 256  # sources of a block; a task has the pairs of two blocks
CELLS = 1 << 21  # counts in a task, about
SENT = 1 << 15  # rows of an Arrow batch


def slices(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about ``SLICE`` bytes, none of which ends inside a term."""
    at = 0
    while len(text) - at > SLICE:
        gap = GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of (lang, source, text): rows (lang, source, term, n, docs), at most ``HELD`` terms and a batch's at a time."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for i in range(0, len(terms), SENT):
                some = terms[i : i + SENT]
                same = lambda v, size=len(some): pa.array([v]).cast(pa.string()).take(pa.array(np.zeros(size, np.int64)))
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source")), batch.column("text").cast(pa.binary()), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for part in slices(text.as_py()):
                words = TERM.findall(part.lower())
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from sent()
    yield from sent()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, total, at)`` of terms that at least ``min_docs`` documents of the language have; ``at`` is an array of (source, n), sorted.
    ``docs``: lang, source, text, no nulls. One shuffle, by language and term, serves both counts."""
    raw = docs.select("lang", "source", "text").mapInArrow(trimmed_batches(_counted), "lang string, source string, term string, n long, docs long")
    per = raw.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return per.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("at")).where(F.col("docs") >= min_docs).drop("docs")


def _share(n: str, of: str) -> Column:
    """1 + floor(UNIT * (n + 2) / of), exact."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) DIV CAST({of} AS DECIMAL(20,0))")


def shares(n: np.ndarray, of: int) -> np.ndarray:
    """:func:`_share` of an array; ``of`` is below 9e17. Long division, a decimal digit at a time, where one product would overflow."""
    if not len(n) or int(n.max()) + 2 < (1 << 63) // UNIT:
        return 1 + (n + 2) * UNIT // of
    out, rest = (n + 2) // of, (n + 2) % of
    for _ in range(len(str(UNIT)) - 1):
        rest = rest * 10
        out, rest = out * 10 + rest // of, rest % of
    return 1 + out


def runs(column: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))


def pair_values(counts: np.ndarray, times: np.ndarray, of: list[int], pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """``(a, b, value)`` of pairs of columns. ``counts``: a row per distinct vector of counts, that ``times`` terms have; ``of``: the divisor
    of each column's shares."""
    distinct = [len(np.unique(c)) for c in counts.T]
    order = np.lexsort([counts[:, c] for c in np.argsort(distinct, kind="stable")[::-1]])  # the last key counts most
    counts, ends = counts[order], np.concatenate([[0], np.cumsum(times[order])])
    starts = [runs(c) for c in counts.T]
    p = [shares(c[s], d) for c, s, d in zip(counts.T, starts, of, strict=True)]
    for a, b in pairs:
        cuts = np.union1d(starts[a], starts[b])
        x, y = (p[c][np.searchsorted(starts[c], cuts, "right") - 1] for c in (a, b))
        length = np.diff(ends[np.concatenate([cuts, [len(counts)]])])
        yield a, b, int(((x - y) ** 2 // (x + y) * length).sum())


def _pairs_of_shard(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """The pairs of two blocks of sources over the terms of a shard; ``groups`` has the sources of both blocks."""
    groups = groups.sort_by("source")
    sources, block, of = (groups.column(c).to_pylist() for c in ("source", "block", "of"))
    out: list[tuple] = []
    if len(terms) and sources:
        place = {s: i for i, s in enumerate(sources)}
        at = terms.combine_chunks().column("vector").chunk(0)
        row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
        flat = at.flatten()
        named = flat.field("source").dictionary_encode()
        col = np.array([place[s] for s in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        counts = np.zeros((len(at), len(sources)), np.int64)
        counts[row, col] = flat.field("n").to_numpy()
        a, b = key[1].as_py(), key[2].as_py()
        wanted = ((i, j) for i in range(len(sources)) for j in range(len(sources)) if (i < j if a == b else block[i] == a and block[j] == b))
        out = [(sources[i], sources[j], v) for i, j, v in pair_values(counts, terms.column("terms").to_numpy(), of, wanted)]
    one, two, value = zip(*out, strict=True) if out else ((), (), ())
    lang = pa.array([key[0].as_py()] * len(out), pa.string())
    return pa.table([lang, pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])


def pair_divergence(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of all ordered pairs of sources of a language. ``groups``: (lang, source, v, of), ``v`` the number of
    kept terms of the language.

    Sources are split into blocks by hash, so a task has the pairs of at most two blocks and a share of the terms, whatever their number.
    """
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("v").alias("v"))
    langs = langs.withColumn("blocks", F.ceil(F.col("sources") / BLOCK).cast("long"))
    langs = langs.withColumn("shards", F.ceil(F.col("v") * F.least("sources", F.lit(2 * BLOCK)) / CELLS).cast("long")).select("lang", "blocks", "shards")
    both = F.explode(F.expr("flatten(transform(sequence(0L, blocks - 1), a -> transform(sequence(a, blocks - 1), b -> struct(a, b))))")).alias("pair")
    block_of = "pmod(xxhash64({}), blocks)"
    met = kept.select("lang", "at").join(langs, "lang").select("lang", "at", "blocks", "shards", both)
    vector = F.expr(f"filter(at, x -> {block_of.format('x.source')} IN (pair.a, pair.b))")
    clusters = met.select("lang", "pair.a", "pair.b", "shards", F.when(F.col("blocks") == 1, F.col("at")).otherwise(vector).alias("vector")).groupBy("lang", "a", "b", "shards", "vector").agg(F.count(F.lit(1)).alias("terms"))
    clusters = clusters.select("lang", "a", "b", F.expr("pmod(xxhash64(vector), shards)").alias("shard"), "vector", "terms")
    sides = groups.join(langs, "lang").where("v > 0").withColumn("block", F.expr(block_of.format("source")))
    sides = sides.select("lang", "source", "of", "block", "blocks", F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard"))
    sides = sides.select("lang", "source", "of", "block", "shard", both).where("block = pair.a OR block = pair.b").select("lang", "pair.a", "pair.b", "shard", "source", "of", "block")
    keys = ["lang", "a", "b", "shard"]
    parts = clusters.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(lambda key, x, y: trimmed(lambda t: _pairs_of_shard(key, t, y))(x), "lang string, a string, b string, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    met = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value").select("lang", "s.source", "s.item", "value")
    bare = groups.where("v = 0").select("lang", "source")
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return met.unionByName(none)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``. Part ``pair``: every other source of the language with the divergence of the two, all ranks.
    Part ``term``: the terms that set the source apart from its language, the ``top`` of each. See the module for nulls and ties."""
    small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    kept = cut(kept_terms(docs, min_docs), "audit-terms")
    each = kept.select("lang", "term", "total", F.explode("at").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    held = each.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("whole"))
    groups = docs.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = cut(groups.select("lang", "source", zero(F.col("v")).alias("v"), (zero(F.col("n")) + 2 * zero(F.col("v"))).alias("of"), (zero(F.col("whole")) + 2 * zero(F.col("v"))).alias("whole_of")), "audit-groups")
    pairs = pair_divergence(kept, groups)
    shared = each.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "of"), "q": _share("total", "whole_of")}).where("p > q")
    terms = shared.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) DIV (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank)
    return part(pairs, "pair").unionByName(part(terms, "term").where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (total + 2)) // (sum(total) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM k),
n AS (SELECT lang, source, term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM n),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
          UNION ALL
          SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
