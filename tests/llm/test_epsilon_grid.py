import brute
import numpy as np
import pytest

from graphloom.llm import epsilon_grid as grid


def vectors(seed, n=150, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    rows = [(i, [float(x) for x in np.float32(centres[rng.integers(0, 20)] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.3]))]) for i in range(n)]
    return rows + [(900, None), (901, [0.0] * dim), (902, [float("nan")] + [1.0] * (dim - 1)), (903, [None] + [1.0] * (dim - 1)), (904, [1.0]), (905, []), (3, rows[9][1]), (None, rows[4][1]), (906, [float("inf")] * dim)]


def expected(rows, dim=6, cosine=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    links = [(i, j) for i in good for j in good if j < i and unit[i] @ unit[j] >= cosine]
    comp = brute.components(range(len(rows)), links)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, sum(i in p for p in links), c, c == d))
    return out


@pytest.mark.parametrize("block", [8, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(grid, "BLOCK", block)
    monkeypatch.setattr(grid, "LEAF", 4)
    rows = vectors(block)
    got = grid.near_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows)))


def check_roots(n, links):
    """Vectors of whose pairs just the given ones are near; the boxes drop nothing."""
    gram = np.eye(n)
    for i, j in links:
        gram[i, j] = gram[j, i] = 0.2
    x, one = np.linalg.cholesky(gram), np.ones(n, np.int64)
    got, root = grid.join_blocks(x, x, one, one, np.zeros((n, 1)), 0.1, True)
    want = brute.components(range(n), links)
    assert got[:n].sum() == 2 * len(links)
    assert all((root[i] == root[j]) == (want[i] == want[j]) for i in range(n) for j in range(n))


def test_groups_over_many_leaves(monkeypatch):
    monkeypatch.setattr(grid, "LEAF", 4)
    check_roots(12, [(2, 4), (3, 8), (3, 9), (1, 10), (0, 11), (4, 9), (4, 10), (8, 11)])
    for seed in range(20):
        order = np.random.default_rng(seed).permutation(80)
        check_roots(80, [(int(a), int(b)) for a, b in zip(order[:-1], order[1:], strict=True)])


def test_empty_and_useless_tables(spark):
    schema = "vec_id long, embedding array<double>, n_links string"
    assert grid.near_pairs(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in grid.near_pairs(spark.createDataFrame([(1, None, "x")], schema)).collect()] == [(1, 0, 1, True)]
