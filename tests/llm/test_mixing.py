import numpy as np
import pytest

from graphloom.llm import mixing


def plain_rake(n, a, b, c, rounds=2000):
    w = n / n.sum()
    for _ in range(rounds):
        for axis, want in enumerate((a, b, c)):
            got = w.sum(tuple(i for i in range(3) if i != axis))
            shape = [1, 1, 1]
            shape[axis] = -1
            w = w * (want / got).reshape(shape)
    return w


def test_raking_equals_plain_version(spark):
    rng = np.random.default_rng(0)
    n = rng.integers(1, 1000, (5, 3, 2)).astype(float)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(n[i, j, k])) for i in range(5) for j in range(3) for k in range(2)], "source string, lang string, topic string, tokens long")
    source = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate([0.1, 0.2, 0.3, 0.25, 0.15])], "source string, target double")
    fit = mixing.rake(cells, source, {"l0": 0.5, "l1": 0.3, "l2": 0.2}, {"t0": 0.7, "t1": 0.3}, tolerance=1e-10)
    want = plain_rake(n, np.array([0.1, 0.2, 0.3, 0.25, 0.15]), np.array([0.5, 0.3, 0.2]), np.array([0.7, 0.3]))
    got = {(r.source, r.lang, r.topic): r.target_share for r in fit.cells.collect()}
    for i in range(5):
        for j in range(3):
            for k in range(2):
                assert got[f"s{i}", f"l{j}", f"t{k}"] == pytest.approx(want[i, j, k], abs=1e-8)


def test_sampling_follows_weights(spark):
    rows = [(i, "some words here " * (1 + i % 5), ["en", "de", None][i % 3], ["big", "big", "big", "small", None][i % 5], "clash") for i in range(4000)]
    rows += [(5000, None, "en", "big", "x"), (5001, "", "en", "big", "x"), (None, "one", "en", "big", "x"), (3, rows[3][1], "en", "big", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    out = mixing.mix(df, alpha=0.3).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert not by[5000].sampled and by[5000].weight == 0 and not by[5001].sampled
    assert all(0 <= r.probability <= 1 for r in out)
    tokens = sum(r.mix_tokens for r in out)
    expect = sum(r.mix_tokens * r.probability for r in out)
    assert sum(r.mix_tokens for r in out if r.sampled) == pytest.approx(expect, rel=0.05)
    assert expect <= mixing.BUDGET * tokens * 1.0001
    small = sum(r.mix_tokens * r.weight for r in out if r.source == "small") / tokens
    shares = {}
    for r in out:
        shares[r.source] = shares.get(r.source, 0) + r.mix_tokens
    target = mixing.tempered(shares, 0.3)["small"]
    assert small == pytest.approx(target, rel=1e-3)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
