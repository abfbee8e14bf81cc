import random

import numpy as np
import pytest

from graphloom.llm import langid

WORDS = {"en": "the and of with this that reading writes whether".split(), "de": "der und mit nicht über zwischen schön ungefähr".split(), "fr": "les des avec être garçon où même".split()}


def texts(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 200))), lang) for i, lang in ((i, rng.choice(list(WORDS))) for i in range(n))]


def test_held_out_accuracy_and_edges(spark):
    rows = texts(400) + [(900, None, "en"), (901, "", "de"), (902, "123 ... !!", "fr"), (903, "über " * 60_000, "de"), (None, "the and of", None), (3, "der und mit", "de"), (904, "\U0001f600", "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    model = langid.fit(docs.where(~langid.held_out()))
    assert model.langs == ["de", "en", "fr"]
    out = langid.predict(docs.withColumn("held_out", langid.held_out()), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[900].lang_pred == by[901].lang_pred == by[902].lang_pred == by[904].lang_pred == "und" and by[903].lang_pred == "de"
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 50 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert sorted(r.doc_id for r in out if r.held_out) == sorted(d for d, *_ in rows if d is not None and __import__("zlib").crc32(str(d).encode()) % 4 == 2)


def test_tables_equal_the_network():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (70, langid.WINDOW)).astype(np.uint8)
    model = langid.train(x, rng.integers(0, 3, 70), ["a", "b", "c"], steps=5)
    e = model.embed[x]
    pooled = []
    for w in langid.WIDTHS:
        z = sum(e[:, j : langid.WINDOW - w + 1 + j] @ model.filters[w][j] for j in range(w)) + model.bias[w]
        pooled.append(np.maximum(z.max(1), 0))
    logits = np.concatenate(pooled, 1) @ model.out + model.out_bias
    want = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    assert langid.Scorer(model).windows(x) == pytest.approx(want, abs=1e-3)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    one = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert langid.fit(one) is None
    assert [(r.lang_pred, r.score) for r in langid.predict(one, None).collect()] == [("und", 0.0)]
