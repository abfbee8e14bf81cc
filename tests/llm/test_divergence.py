"""The audit of sources against a plain version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import divergence as dv


def plain(rows, min_docs=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        mine = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in mine:
            whole.update(counts[lang, s])
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept))  # noqa: B023, E731
        p = {s: {t: share(counts[lang, s], t) for t in kept} for s in mine}
        q = {t: share(whole, t) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(items[:limit])}
    return out


def sample(n=400, sources=7, seed=3):
    r = np.random.default_rng(seed)
    words = ["Ab", "aB", "ä", "Ä", "日本", "c3d", "x-y", "İ", "ﬀ", "K"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(12)]
    rows = []
    for _ in range(n):
        s = int(r.integers(0, sources))
        some = r.choice(len(words), int(r.integers(0, 40)), p=np.roll(np.arange(1, len(words) + 1) / (len(words) * (len(words) + 1) / 2), s))
        rows.append((" ".join(words[i] for i in some), ["en", "de"][int(r.integers(0, 2))], None if s == 0 else f"s{s}"))
    return [*rows, (None, "en", "s1"), ("", None, None), ("rare words", "fr", "s1"), ("", "fr", "s2"), ("", "fr", "é"), *[("solo term",  "it", "only")] * 12]


def found(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


@pytest.mark.parametrize(("block", "cells", "held", "slice_"), [(256, 1 << 21, 400_000, 4 << 20), (3, 60, 20, 16), (1, 10_000, 400_000, 1)])
def test_against_plain(spark, tmp_path, monkeypatch, block, cells, held, slice_):
    """Blocks, shards, flushes and slices of every size give the same."""
    for name, value in (("BLOCK", block), ("CELLS", cells), ("HELD", held), ("SLICE", slice_)):
        monkeypatch.setattr(dv, name, value)
    rows = sample()
    spark.createDataFrame([(*x, "clash", 1) for x in rows], "text string, lang string, source string, term string, rank int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = found(dv.op13_source_divergence(spark, str(tmp_path)))
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_sql(spark, tmp_path):
    import duckdb

    rows = sample(200, 4, 9)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1).write.parquet(path)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert set(duckdb.sql(dv.OP13_SQL).fetchall()) == plain(rows) == set(found(dv.op13_source_divergence(spark, str(tmp_path))))


def test_empty_and_long(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert found(dv.audit(docs)) == []
    rows = [("Alpha beta " * 600_000 + "gamma" * 1_000_000, "en", "a"), ("beta delta", "en", "b"), ("beta", "en", "b")]
    assert set(found(dv.audit(spark.createDataFrame(rows, "text string, lang string, source string"), min_docs=1))) == plain(rows, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**16), min_size=1, max_size=20), st.integers(0, 10**15))
def test_shares_do_not_overflow(n, more):
    of = sum(n) + 2 * len(n) + more
    assert dv.shares(np.array(n, np.int64), of).tolist() == [1 + 10**9 * (x + 2) // of for x in n]
