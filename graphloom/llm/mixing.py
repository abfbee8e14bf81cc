"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic). Factors of each source, language and topic are raked until the weighted sums have
the target marginals. Sources may be many, so their factors stay in a table, one row per source with its small matrix of languages
and topics: a sweep updates them without a shuffle, and only a matrix of languages by topics comes back to the driver.

Texts are read once: a written table has each row's topic, tokens and draw, and the sums and the sampling both start from it.
"""

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import cut

NONE = "∅"  # a null source or language is a stratum of its own
ALPHA = 0.7
BUDGET = 0.5
SWEEPS = 30
TOLERANCE = 1e-6
MAX_STRATA = 100_000  # languages times topics

# Topics by features of the text, the first that holds; a parameter of the operator. The patterns need no backtracking, so that a
# long run of letters or digits costs its length.
TOPICS = (
    ("licence", r"(?i)\b(?:licen[cs]e|copyright|permission|warranty)\b"),
    ("contact", r"[\w.]@[\w.]|\+\d[\d ()-]{6}"),
    ("table", r" \| "),
    ("numeric", r"\d{6}"),
)
OTHER = "prose"


def topic(text: Column, topics=TOPICS, other: str = OTHER) -> Column:
    out = F.lit(other)
    for name, pattern in reversed(topics):
        out = F.when(F.coalesce(text.rlike(pattern), F.lit(False)), F.lit(name)).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Runs of other characters than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass
class Fit:
    """Calibrated weights: one row per (source, lang, topic) with its tokens, share before and share after; the sweeps made, and the
    largest error of a marginal that was left."""

    cells: DataFrame
    sweeps: int
    error: float


def tempered(totals: Mapping, alpha: float) -> dict:
    """Targets between the given shares (1) and equal ones (0)."""
    raised = {k: v**alpha for k, v in totals.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def rake(cells: DataFrame, source_target: DataFrame | None = None, lang_target: Mapping[str, float] | None = None, topic_target: Mapping[str, float] | None = None, alpha: float = ALPHA, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> Fit:
    """Rake ``cells`` (source, lang, topic, tokens; no nulls) to marginals. Targets are shares; one left out is the tempered share of
    the tokens. ``source_target``: (source, target). Strata without tokens or target get no weight. Sweeps go on until the largest
    error of a marginal is below the tolerance, or ``sweeps`` are made: marginals may contradict one another where cells are empty
    (a source with one language), and then ``error`` says by how much they are missed. The source marginal is updated last, so it is met
    exactly. More than ``MAX_STRATA`` combinations of language and topic are an error.
    """
    cells = cells.where("tokens > 0")
    strata = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(MAX_STRATA + 1).collect()
    if len(strata) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} combinations of language and topic")
    spark = cells.sparkSession
    if not strata:
        return Fit(cells.withColumn("share", F.lit(0.0)).withColumn("target_share", F.lit(0.0)), 0, 0.0)
    total = float(sum(r.tokens for r in strata))
    sums = {"lang": {}, "topic": {}}
    for r in strata:
        for k in sums:
            sums[k][r[k]] = sums[k].get(r[k], 0) + r.tokens
    langs, topics = sorted(sums["lang"]), sorted(sums["topic"])
    want_lang = np.array([(lang_target or tempered(sums["lang"], alpha)).get(x, 0.0) for x in langs])
    want_topic = np.array([(topic_target or tempered(sums["topic"], alpha)).get(x, 0.0) for x in topics])
    want_lang, want_topic = want_lang / want_lang.sum(), want_topic / want_topic.sum()
    place = spark.createDataFrame([(a, b, i * len(topics) + j) for i, a in enumerate(langs) for j, b in enumerate(topics)], "lang string, topic string, k int")
    per = cells.join(place, ["lang", "topic"]).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.collect_list(F.struct("k", F.col("tokens").cast("double").alias("n"))).alias("strata"))
    if source_target is None:
        per = per.withColumn("raised", F.pow("tokens", F.lit(alpha)))
    else:
        per = per.join(source_target.select("source", F.col("target").alias("raised")), "source")
    per = cut(per, "mixing-sources")
    whole = per.agg(F.sum("raised")).first()[0] or 1.0
    b, c = np.ones(len(langs)), np.ones(len(topics))
    error, done = np.inf, 0
    for done in range(1, sweeps + 1):
        got = np.zeros((len(langs), len(topics)))
        for r in _weights(per, whole, b, c).groupBy("k").agg(F.sum("w").alias("w")).collect():
            got[r.k // len(topics), r.k % len(topics)] = r.w
        got /= max(got.sum(), 1e-300)
        error = max(np.abs(got.sum(1) - want_lang).max(), np.abs(got.sum(0) - want_topic).max())
        if error < tolerance:
            break
        step = np.divide(want_lang, got.sum(1), out=np.zeros_like(b), where=got.sum(1) > 0)
        b, got = b * step, got * step[:, None]
        c = c * np.divide(want_topic, got.sum(0), out=np.zeros_like(c), where=got.sum(0) > 0)
        b, c = b / max(b.max(), 1e-300), c / max(c.max(), 1e-300)
    weights = _weights(per, whole, b, c).join(place, "k").select("source", "lang", "topic", F.col("n").cast("long").alias("tokens"), (F.col("n") / total).alias("share"), F.col("w").alias("target_share"))
    return Fit(weights, done, float(error))


def _weights(per: DataFrame, whole: float, b: np.ndarray, c: np.ndarray) -> DataFrame:
    """Weights (source, k, n, w) with every source at its target, given the factors of languages and topics (at most ``MAX_STRATA``)."""
    sent = per.sparkSession.sparkContext.broadcast(np.outer(b, c).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = sent.value
        for batch in batches:
            strata = batch.column("strata")
            size = strata.value_lengths().to_numpy()
            k, n = (strata.flatten().field(x).to_numpy() for x in "kn")
            row = np.repeat(np.arange(len(size)), size)
            w = n * factor[k]
            held = np.bincount(row, w, len(size))
            w = w * np.divide(batch.column("raised").to_numpy() / whole, held, out=np.zeros(len(size)), where=held > 0)[row]
            yield pa.RecordBatch.from_arrays([batch.column("source").take(pa.array(row)), pa.array(k, pa.int32()), pa.array(n), pa.array(w)], ["source", "k", "n", "w"])

    return per.select("source", "strata", F.col("raised").cast("double").alias("raised")).mapInArrow(run, "source string, k int, n double, w double")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, budget: float = BUDGET, seed: int = 17, keep_text: bool = True, **options) -> DataFrame:
    """``docs`` with ``topic``, ``mix_tokens``, ``weight`` (calibrated over given share of the row's stratum), ``probability``,
    ``sampled`` and ``mix_error`` (the largest miss of a target share, the same in every row); columns so named are replaced, and with
    ``keep_text=False`` the text is left out. ``topic_col`` names a column of topics to use in place of ``TOPICS``.

    A document is sampled when a hash of its id and text and the seed, taken as a number in [0, 1), is below
    ``min(1, budget * weight)``: about ``budget`` of all tokens, in the target proportions as far as no probability is cut at 1.
    Null sources, languages and topics are strata of their own; a text without tokens (null, empty) has weight 0 and is not sampled.
    Rows with the same id and text share one draw, so they stay or go together. An empty table gives an empty one.
    """
    new = ["topic", "mix_tokens", "weight", "probability", "sampled", "mix_error"]
    text = F.col(text_col)
    topics = topic(text) if topic_col is None else F.coalesce(F.col(topic_col).cast("string"), F.lit(NONE))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    stratum = {"__mix_s": F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)), "__mix_l": F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)), "__mix_t": topics, "__mix_n": tokens(text), "__mix_d": draw}
    kept = [c for c in docs.columns if (c not in new or c in (id_col, text_col, source_col, lang_col)) and (keep_text or c != text_col)]
    marked = cut(docs.withColumns(stratum).select(*kept, *stratum), "mixing-rows")
    cells = cut(marked.groupBy(F.col("__mix_s").alias("source"), F.col("__mix_l").alias("lang"), F.col("__mix_t").alias("topic")).agg(F.sum("__mix_n").alias("tokens")), "mixing-cells")
    fit = rake(cells, **options)
    ratio = fit.cells.select(F.col("source").alias("__mix_s"), F.col("lang").alias("__mix_l"), F.col("topic").alias("__mix_t"), F.try_divide("target_share", "share").alias("__mix_r"))
    joined = marked.join(cut(ratio, "mixing-ratio"), ["__mix_s", "__mix_l", "__mix_t"], "left")
    weight = F.when(F.col("__mix_n") > 0, F.coalesce("__mix_r", F.lit(0.0))).otherwise(F.lit(0.0))
    out = joined.withColumns({"topic": F.col("__mix_t"), "mix_tokens": F.col("__mix_n"), "weight": weight}).withColumn("probability", F.least(F.lit(1.0), F.col("weight") * budget))
    return out.withColumn("sampled", F.col("__mix_d") < F.col("probability")).withColumn("mix_error", F.lit(fit.error)).select(*kept, *[c for c in new if c not in kept])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs, keep_text=False).select("doc_id", "source", "lang", "topic", F.col("mix_tokens").alias("n_tokens"), "weight", "probability", "sampled", "mix_error")
