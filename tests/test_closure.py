import random

import pytest
from graphs import pairs

from graphloom.operators import closure
from graphloom.operators.components import connected_components


def table(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def reach(rows):
    got = set(rows)
    while True:
        more = {(a, d) for a, b in got for c, d in rows if b == c} - got
        if not more:
            return sorted(got)
        got |= more


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(15), rng.randrange(15)) for _ in range(18)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    df = table(spark, rows)
    assert pairs(closure.transitive_closure(df)) == reach(rows)
    both = rows + [(b, a) for a, b in rows]
    assert pairs(closure.equivalence_closure(df)) == reach(both)
    assert pairs(closure.symmetric_closure(df)) == sorted(set(both))
    again = closure.transitive_closure(closure.transitive_closure(df))
    assert pairs(again) == reach(rows)


def test_long_path_and_guards(spark):
    path = table(spark, [(i, i + 1) for i in range(300)])
    got = {r.id: r.component for r in connected_components(path).collect()}
    assert got == dict.fromkeys(range(301), 0)
    with pytest.raises(RuntimeError):
        closure.equivalence_closure(path, max_pairs=10)
    with pytest.raises(RuntimeError):
        closure.transitive_closure(path, max_pairs=400)
    assert closure.equivalence_closure(path, emit="components", max_pairs=1).count() == 301


def test_empty_and_null(spark):
    none = table(spark, [])
    assert pairs(closure.transitive_closure(none)) == [] == pairs(closure.equivalence_closure(none))
    assert {tuple(r) for r in connected_components(table(spark, [(3, 3), (None, 1), (5, 4)])).collect()} == {(3, 3), (4, 4), (5, 4)}


def test_pair_is_met_once_in_a_tree(spark, monkeypatch):
    """A path of 7 edges takes three rounds, of which none finds a pair twice and none is empty."""
    tables = []
    real = closure.written
    monkeypatch.setattr(closure, "written", lambda df, name: tables.append(name) or real(df, name))
    assert len(pairs(closure.transitive_closure(table(spark, [(i, i + 1) for i in range(7)])))) == 28
    assert tables == ["closure", *["closure-delta"] * 3]


@pytest.mark.parametrize("n", (1, 2, 3, 4, 5, 8))
def test_cycles_with_tails(spark, n):
    rows = [(i, (i + 1) % n) for i in range(n)] + [(0, 50), (50, 51), (51, 52), (60, 0)]
    assert pairs(closure.transitive_closure(table(spark, rows))) == reach(rows)
