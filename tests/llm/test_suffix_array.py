import random

import brute
import numpy as np
import pytest

from graphloom.llm import suffix_array as sa


@pytest.mark.parametrize("seed", range(8))
def test_order_and_common_prefixes(seed, monkeypatch):
    monkeypatch.setattr(sa, "SMALL", 3)
    monkeypatch.setattr(sa, "BASE", (0, 40)[seed % 3 == 0])
    rng = np.random.default_rng(seed)
    for symbols in (1, 2, 4, 250, 1000):
        n = int(rng.integers(1, 400))
        t = rng.integers(0, symbols, n).astype(np.uint8 if symbols <= 256 else np.int64)
        if seed % 2:
            t = np.tile(t[:9], 40)[:n]
        x = t.tolist()
        order = sa.suffix_array(t, symbols)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        common = sa.permuted_common_prefixes(t, order)
        for a, b in zip(order[:-1], order[1:], strict=True):
            same = 0
            while max(a, b) + same < len(x) and x[a + same] == x[b + same]:
                same += 1
            assert common[b] == same


def random_docs(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts.insert(rng.randint(0, len(parts)), p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)])
        rows.append((i, rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 3000), (n + 3, "x" * 200), (3, rows[3][1]), (None, rows[5][1]), (n + 4, rows[7][1]), (n + 5, rows[7][1]), (n + 6, "ab" * 400)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_removal_equals_brute_force(spark, seed):
    rows = random_docs(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sa.remove_repeated_bytes(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.repeated_bytes(rows, 50)))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_bytes string")
    out = sa.remove_repeated_bytes(empty, keep_text="text")
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"] and out.count() == 0
    long = "é" * 60
    df = spark.createDataFrame([(1, long, "a", 5), (2, "z" + long, "b", 6), (3, None, "c", 7)], "doc_id long, text string, source string, n_removed int")
    rows = {r.doc_id: r for r in sa.remove_repeated_bytes(df, keep_text="text").collect()}
    assert rows[1].text == long and rows[2].text == "z" and rows[3].text is None and rows[2].source == "b"
