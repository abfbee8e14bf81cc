import random

import pytest
from graphs import pairs
from test_closure import reach, table

from graphloom.operators import condense


def strong(rows):
    """Components by enumeration: nodes that reach one another."""
    got, ids = set(reach(rows)), {x for r in rows for x in r}
    return {a: min(b for b in ids if a == b or ((a, b) in got and (b, a) in got)) for a in ids}


def found(df):
    rows = df.collect()
    got = {r.id: r.component for r in rows}
    assert len(got) == len(rows)
    return got


def digraph(seed, n=24, m=34):
    rng = random.Random(seed)
    ring = [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ring + [(3, 204), (300, 301), (301, 302), (7, 7), (3, 204)]


@pytest.mark.parametrize("seed", range(1))
def test_components_and_closure_by_class(spark, seed):
    rows = digraph(seed)
    assert found(condense.strong_components(table(spark, rows))) == strong(rows)
    members, by_class = condense.condensed_closure(table(spark, rows))
    assert pairs(condense.closure_pairs(members, by_class)) == reach(rows)
    ids = sorted({x for r in rows for x in r})
    asked = [(random.Random(i).choice(ids), random.Random(-i).choice(ids)) for i in range(1, 60)] + [(7, 7), (300, 300), (9999, 3), (None, 3), (7, 7)]
    got = condense.reaches(spark.createDataFrame(asked, "a long, b long"), members, by_class).collect()
    assert len(got) == len(asked)
    assert {(r.a, r.b): r.reach for r in got} == {p: p in set(reach(rows)) for p in asked}


def test_dense_graph_is_coloured(spark, monkeypatch):
    """Every node has several edges each way, so nothing is taken off or passed over."""
    blocks = [[(10 * k + i, 10 * k + (i + s) % 10) for i in range(10) for s in (1, 3)] for k in range(3)]
    rows = sum(blocks, []) + [(5, 12), (6, 13), (15, 22)]
    called = []
    one = condense._coloured
    monkeypatch.setattr(condense, "_coloured", lambda e: called.append(1) or one(e))
    assert found(condense.strong_components(table(spark, rows))) == {i: i // 10 * 10 for i in range(30)}
    assert called


def test_large_component_without_its_pairs(spark):
    """A cycle of 100,000 nodes with a chord at each: its 10^10 pairs are refused, its members and answers are at hand."""
    n = 100_000
    ids = spark.range(n)
    edges = ids.selectExpr("id AS src", f"(id + 1) % {n} AS dst").union(ids.selectExpr("id AS src", f"(id * 7919 + 13) % {n} AS dst")).union(spark.range(1).selectExpr("5L", f"{n}L"))
    members, by_class = condense.condensed_closure(edges)
    assert {(r.component, r["count"]) for r in members.groupBy("component").count().collect()} == {(0, n), (n, 1)}
    assert pairs(by_class) == [(0, 0), (0, n)]
    asked = spark.createDataFrame([(99_999, 1), (1, n), (n, 1)], "a long, b long")
    assert {(r.a, r.b): r.reach for r in condense.reaches(asked, members, by_class).collect()} == {(99_999, 1): True, (1, n): True, (n, 1): False}
    with pytest.raises(RuntimeError):
        condense.closure_pairs(members, by_class, max_pairs=n)


def test_long_cycle_and_path_take_few_rounds(spark, monkeypatch):
    rows = [(i, (i + 1) % 400) for i in range(400)] + [(1000 + i, 1001 + i) for i in range(400)] + [(17, 1000)]
    rounds = []
    one = condense._reduced
    monkeypatch.setattr(condense, "_reduced", lambda e, seed: rounds.append(1) or one(e, seed))
    monkeypatch.setattr(condense, "_coloured", None)
    assert found(condense.strong_components(table(spark, rows))) == {**dict.fromkeys(range(400), 0), **{i: i for i in range(1000, 1401)}}
    assert len(rounds) < 30


@pytest.mark.parametrize("seed", range(1))
def test_extension_equals_recomputation(spark, seed):
    rows = digraph(seed, 20, 22)
    rng = random.Random(seed)
    known = set(reach(rows))
    for _ in range(2):
        added = [(rng.randrange(22), rng.randrange(22)) for _ in range(4)] + rng.sample(sorted(known), 1) + [(None, 3)]
        after = set(reach([*known, *(p for p in added if None not in p)]))
        assert pairs(condense.extend_closure(table(spark, sorted(known)), table(spark, added))) == sorted(after - known)
        known = after


def test_empty(spark):
    none = table(spark, [])
    assert found(condense.strong_components(none)) == {}
    assert found(condense.strong_components(table(spark, [(4, 4), (None, 1)]))) == {4: 4}
    members, by_class = condense.condensed_closure(none)
    assert pairs(condense.closure_pairs(members, by_class)) == []
    assert pairs(condense.extend_closure(none, none)) == []
    assert pairs(condense.extend_closure(none, table(spark, [(1, 2), (2, 1)]))) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert pairs(condense.extend_closure(table(spark, [(1, 2)]), none)) == []
