"""Language identification by a byte convolutional network trained in numpy.

Filters of several widths over byte embeddings, max pooling over a window of ``WINDOW`` bytes, softmax. A text is cut into
whole windows, every one is scored, and their log-probabilities are averaged by the bytes they hold, so that whole texts count.
For use, embeddings and filters are folded into tables indexed by byte pairs; a window is then a few table reads and a maximum.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import small_batches, trimmed_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
MAX_TRAIN_DOCS = 4000  # the bound on the labelled sample
WINDOWS_PER_DOC = 3
CHUNK = 256  # windows scored at a time, so that what they gather stays in cache


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # [256, EMBED]
    filters: dict[int, np.ndarray]  # width -> [width, EMBED, FILTERS]
    bias: dict[int, np.ndarray]
    out: np.ndarray  # [len(WIDTHS) * FILTERS, langs]
    out_bias: np.ndarray


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = 250, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on cross-entropy. ``windows``: uint8 [n, WINDOW], ``labels``: indices into ``langs``."""
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.5, (256, EMBED)), "O": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), "o": np.zeros(len(langs))}
    for w in WIDTHS:
        p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), min(batch, len(windows)))
        x, y = windows[pick], labels[pick]
        n = len(x)
        e = p["E"][x]
        pooled, where, cols = [], {}, {}
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)  # [n, pos, EMBED, w]
            cols[w] = view.transpose(0, 1, 3, 2).reshape(n, -1, w * EMBED)
            z = cols[w] @ p[f"W{w}"] + p[f"b{w}"]
            where[w] = z.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(z, where[w][:, None, :], 1)[:, 0, :], 0))
        h = np.concatenate(pooled, 1)
        logits = h @ p["O"] + p["o"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"O": h.T @ q, "o": q.sum(0), "E": np.zeros_like(p["E"])}
        back = (q @ p["O"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]  # [n, F]
            at = cols[w][np.arange(n)[:, None], where[w]]  # [n, F, w*EMBED]
            g[f"W{w}"] = np.einsum("nf,nfk->kf", d, at)
            g[f"b{w}"] = d.sum(0)
            de = d[:, :, None] * p[f"W{w}"].T[None]  # [n, F, w*EMBED]
            for j in range(w):
                np.add.at(g["E"], x[np.arange(n)[:, None], where[w] + j], de[:, :, j * EMBED : (j + 1) * EMBED])
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
            p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(langs, p["E"], {w: p[f"W{w}"].reshape(w, EMBED, FILTERS) for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["O"], p["o"])


class Scorer:
    """A model with its filters folded into tables of byte pairs."""

    def __init__(self, model: Model):
        self.model, self.steps = model, {}
        for w in WIDTHS:
            single = [model.embed @ model.filters[w][j] for j in range(w)]  # [256, F] each
            single[0] = single[0] + model.bias[w]
            pairs = [(j, (single[j][None, :, :] + single[j + 1][:, None, :]).reshape(65536, FILTERS).astype(np.float32)) for j in range(0, w - 1, 2)]
            self.steps[w] = pairs, ([(w - 1, single[w - 1].astype(np.float32))] if w % 2 else [])

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities [n, langs] of uint8 windows [n, WINDOW]."""
        out = np.empty((len(x), len(self.model.langs)), np.float32)
        for at in range(0, len(x), CHUNK):
            part = x[at : at + CHUNK]
            pair = part[:, :-1].astype(np.uint16) | (part[:, 1:].astype(np.uint16) << 8)  # low byte first
            pooled = []
            for w in WIDTHS:
                n, (pairs, singles) = WINDOW - w + 1, self.steps[w]
                z = np.take(pairs[0][1], pair[:, :n], axis=0)
                for j, table in pairs[1:]:
                    z += np.take(table, pair[:, j : j + n], axis=0)
                for j, table in singles:
                    z += np.take(table, part[:, j : j + n], axis=0)
                pooled.append(np.maximum(z.max(1), 0))
            logits = np.concatenate(pooled, 1) @ self.model.out + self.model.out_bias
            top = logits.max(1, keepdims=True)
            out[at : at + CHUNK] = logits - top - np.log(np.exp(logits - top).sum(1, keepdims=True))
        return out

    def texts(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each non-empty text: the index of the best language and its probability."""
        best, score, group, held = [], [], [], 0
        for i, x in enumerate(data):  # a few MB of whole texts at a time
            group.append(x)
            held += len(x)
            if held >= 4 << 20 or i == len(data) - 1:
                counts = np.array([-(-len(x) // WINDOW) for x in group])
                flat = np.frombuffer(b"".join(x.ljust(c * WINDOW, b" ") for x, c in zip(group, counts, strict=True)), np.uint8).reshape(-1, WINDOW)
                ends = np.cumsum(counts)
                weight = np.full(len(flat), float(WINDOW))
                weight[ends - 1] = [len(x) - (c - 1) * WINDOW for x, c in zip(group, counts, strict=True)]
                total = np.add.reduceat(self.windows(flat) * weight[:, None], ends - counts, axis=0) / np.array([len(x) for x in group])[:, None]
                prob = np.exp(total - total.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                best.append(prob.argmax(1))
                score.append(prob.max(1))
                group, held = [], 0
        return (np.concatenate(best), np.concatenate(score)) if best else (np.zeros(0, int), np.zeros(0))


def _bytes_window(text: str) -> np.ndarray:
    return np.frombuffer(text.encode()[:WINDOW].ljust(WINDOW, b" "), np.uint8)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS, **options) -> Model | None:
    """Train on at most ``max_docs`` labelled rows, chosen by a hash of the id, and ``WINDOWS_PER_DOC`` windows of each.

    Rows with a null label or a text without letters teach nothing. None when no row is left.
    The driver gets at most ``max_docs * WINDOWS_PER_DOC`` windows of ``WINDOW`` characters; the hash is also cut at a level that
    leaves a few times ``max_docs`` rows, so that all tasks together send the driver little, however many they are.
    """
    text, key = F.col(text_col), F.xxhash64(F.col(id_col).cast("string"))
    spots = [F.substring(text, (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(i)), F.greatest(F.length(text) - WINDOW + 1, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)) for i in range(WINDOWS_PER_DOC)]
    taught = docs.where(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
    share = min(1.0, 4 * max_docs / max(1, docs.where(F.col(lang_col).isNotNull()).count()))
    taught = taught.where(F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = taught.select(key.alias("k"), F.col(lang_col).alias("lang"), F.array(*spots).alias("spots")).orderBy("k", "lang").limit(max_docs).collect()
    pairs = sorted((r.k, r.lang, s) for r in rows for s in r.spots if any(c.isalpha() for c in s))
    if not pairs:
        return None
    langs = sorted({lang for _, lang, _ in pairs})
    index = {lang: i for i, lang in enumerate(langs)}
    return train(np.stack([_bytes_window(s) for *_, s in pairs]), np.array([index[lang] for _, lang, _ in pairs]), langs, **options)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability; columns already so named are replaced.

    ``und`` with score 0 where the text is null or has no letters, and everywhere when nothing was learned.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop(pred_col, score_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    letters, names = "__has_letters", kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            flags = batch.column(letters).to_pylist()
            pred, score = np.full(len(flags), "und", object), np.zeros(len(flags))
            at = np.array([i for i, x in enumerate(flags) if x and scorer], int)
            if len(at):
                texts = batch.column(text_col)
                best, prob = scorer.texts([texts[int(i)].as_py().encode() for i in at])
                pred[at], score[at] = np.array(model.langs, object)[best], prob
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, pred_col, score_col])

    return kept.withColumn(letters, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))).mapInArrow(trimmed_batches(run), schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.drop("lang"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
