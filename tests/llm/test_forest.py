import random

import brute
import numpy as np

from graphloom.llm import forest


def near_docs(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 6)):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "one  two"), (904, "two one"), (5, rows[20][1]), (905, "\n"), (None, rows[3][1]), (906, " ".join(["x"] * 5000))]
    return rows


def expected(rows, threshold=0.8):
    sets = [brute.shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold]
    comp = brute.components(range(len(rows)), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(comp[i], []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[comp[i]] if x is not None]
        cls = min(ids) if ids else None
        out.append((d, cls, sum(i in p for p in links), len(sets[i]), cls == d))
    return out


def test_join_equals_brute_force(spark):
    rows = near_docs()
    joined = forest.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert joined.first().recall >= forest.RECALL
    got = joined.drop("recall").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows)))


def test_null_and_repeated_ids(spark):
    rng = random.Random(9)
    rows = [(None if i % 2 else 7, " ".join(f"v{rng.randrange(40)}" for _ in range(30))) for i in range(400)]
    rows += [(None, rows[i][1]) for i in range(50)] + [(8, rows[3][1] + " more")]
    got = forest.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).drop("recall").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows)))


def test_prefixes_stay_long_where_only_copies_are_alike(spark):
    rng = random.Random(4)
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(400)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts)]
    deep, depths = forest.depth_for, []
    forest.depth_for = lambda *a: depths.append(deep(*a)) or depths[-1]
    try:
        got = forest.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        forest.depth_for = deep
    assert depths[1] > depths[0] and sum(r.kept for r in got) == 40 and all(r.n_links == 1 for r in got)


def test_sizes_of_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(forest, "CELL_BYTES", 2000)
    rows = near_docs(5)
    got = forest.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).drop("recall").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows)))


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 4)
    rows = near_docs(3)
    got = forest.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).drop("recall").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows)))


def test_dense_and_sparse_counts_agree():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(60, 80), replace=False), rng.integers(0, 1 << 60, 3).astype(np.uint64)])) for _ in range(90)]
    i, j = forest.linked_pairs(sets, np.zeros(len(sets), int), 0.8)
    plain = {(a, b) for b in range(90) for a in range(b) if len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == plain and plain


def test_empty_table_and_depth(spark):
    assert forest.jaccard_join(spark.createDataFrame([], "doc_id long, text string, class_id string")).count() == 0
    assert forest.depth_for(0.5, 0.8) > forest.depth_for(0.9999, 0.8) > 0
