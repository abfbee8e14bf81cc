import pytest
from graphs import companies, make, node

from graphloom.model import label_edges
from graphloom.operators import algebra, patterns, profile
from graphloom.plans.config import Hop, Rel


def test_existence_one_and_bulk(spark):
    n, e = companies(spark)
    le = label_edges(n, e)
    assert patterns.pattern_exists(le, Hop("founder", "Company", "Person"), Hop("founder", "Company", "Person", True))
    assert not patterns.pattern_exists(le, Hop("founder", "Company", "Person"), Hop("founder", "Person", "Company", True))
    rels = [Rel("founder", ("Company",), ("Person",)), Rel("cooperate", ("Company",), ("Company",))]
    found = patterns.prune_patterns(le, patterns.enumerate_patterns(spark, rels)).collect()
    assert len(found) == 10
    for r in found:
        hops = [Hop(r[f"type{i}"], r[f"start{i}"], r[f"end{i}"], r[f"inverse{i}"]) for i in (1, 2)]
        assert r["exists"] == patterns.pattern_exists(le, *hops), r
    more = patterns.enumerate_patterns(spark, [*rels, Rel("VREL", ("Company",), ("Company",))], {"VREL"})
    assert more.count() == 16


def test_single_edge_patterns(spark):
    n, e = make(spark, [node(1, "A"), node(2, "B")], [(1, "r", 2)])
    le = label_edges(n, e)
    found = patterns.prune_patterns(le, patterns.enumerate_patterns(spark, [Rel("r", ("A",), ("B",))])).collect()
    assert len(found) == 2 and not any(r["exists"] for r in found)


def test_hops_of_patterns_are_counted_once_for_each_end(spark):
    """Loops, parallel edges and several labels; edges that no pattern names are not given labels, and hops are not moved by name."""
    n, e = make(spark, [node(1, "A"), node(2, "B"), node(3, "A", "B"), node(4, "A")], [(1, "r", 2), (3, "r", 3), (4, "s", 2), (4, "s", 2), (3, "s", 1), (1, "x", 2)])
    le = label_edges(n, e)
    asked = patterns.enumerate_patterns(spark, [Rel("r", ("A", "B"), ("B",)), Rel("s", ("A",), ("A", "B"))])
    found = patterns.prune_patterns(le, asked)
    want = {r.pattern_id: patterns.pattern_exists(le, *(Hop(r[f"type{i}"], r[f"start{i}"], r[f"end{i}"], r[f"inverse{i}"]) for i in (1, 2))) for r in asked.collect()}
    assert {r.pattern_id: r["exists"] for r in found.collect()} == want and len(set(want.values())) == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan or "IN (r,s)" in plan
    assert not any("Aggregate [side" in x for x in plan.splitlines())
    assert patterns.prune_patterns(le, asked.where("false")).count() == 0


def test_profile(spark):
    n, e = companies(spark)
    le = label_edges(n, e)
    assert profile.rel_frequency(le, "Company", "founder", "Person").first()[0] == 1.0
    assert profile.rel_frequency(le, "Person", "founder", "Company").first()[0] == 0.0
    assert [tuple(r) for r in profile.domain_range(le).collect()] == [("founder", ["Company"], ["Person"])]
    assert profile.infer_view_config(le).labels == ("Company", "Person")
    assert [r.type for r in profile.rel_types(e, limit=1, skip=2).collect()] == ["founder"]
    assert profile.rel_types(e, limit=5, skip=4).count() == 0


def test_algebra(spark):
    n, e = companies(spark)
    degree = {r.id: tuple(r)[1:] for r in algebra.node_degree(n, e).collect()}
    assert degree[2] == (2, 0, 2) and degree[11] == (0, 2, 2)
    asked = spark.createDataFrame([(1, 3), (1, 1), (1, None), (77, 1), (77, 77)], "a long, b long")
    got = lambda k: {(r.a, r.b): r.reach for r in algebra.reach_in_k(e, asked, k).collect()}
    assert got(4) == {(1, 3): True, (1, 1): True, (1, None): False, (77, 1): False, (77, 77): True}
    assert not got(3)[1, 3]
    with pytest.raises(ValueError):
        algebra.reach_in_k(e, asked, 0)
    first = e.where("src = 2 and dst = 11")
    assert {r.neighbour for r in algebra.neighbour_rels(e, first).collect()} == {r.edge_id for r in e.where("(src = 1 and dst = 11) or (src = 2 and dst = 12)").collect()}
    counts = {r.edge_id: r.n for r in algebra.neighbour_counts(e).collect()}
    for edge, c in counts.items():
        assert c == algebra.neighbour_rels(e, e.where(f"edge_id = '{edge}'")).count()
    left, kept = algebra.remove_rels(n, e, e.where("src = 1").select("edge_id"))
    assert {r.id for r in left.collect()} == {2, 3, 11, 12} and kept.count() == 3
    inside, edges = algebra.induced(n, label_edges(n, e), ["Company"])
    assert inside.count() == 3 and edges.count() == 0
    un, ue = algebra.union_graphs(n.where("id = 1"), e, n.where("id = 2"), e)
    assert un.count() == 5 and ue.count() == 4 and un.where("size(labels) = 0").count() == 3


def test_two_hop_pairs_with_a_loop(spark):
    _, e = make(spark, [node(1, "A")], [(1, "r", 1), (1, "r", 2), (1, "s", 2)])
    got = {(r.type1, r.type2): r.n for r in patterns.two_hop_type_pairs(e).collect()}
    plain = {}
    rows = [(x.edge_id, x.type, {x.src, x.dst}) for x in e.collect()]
    for i, t, a in rows:
        for j, u, b in rows:
            if i != j:
                plain[t, u] = plain.get((t, u), 0) + len(a & b)
    assert got == plain


def test_pairs_that_have_met_leave_the_frontiers(spark, monkeypatch):
    """A star whose pairs meet at once, and a path whose pair does not: from the second step on only the path's frontier grows."""
    star = [(0, "t", i) for i in range(1, 40)] + [(i, "t", 100 + i) for i in range(1, 40)]
    path = [(200 + i, "t", 201 + i) for i in range(6)]
    _, e = make(spark, [node(0, "A")], star + path)
    asked = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(200, 206), (200, 999)], "a long, b long")
    grown = []
    one = algebra.cut

    def counted(df, name):
        out = one(df, name)
        if name == "reach-front":
            grown.append(out.count())
        return out

    monkeypatch.setattr(algebra, "cut", counted)
    got = {(r.a, r.b): r.reach for r in algebra.reach_in_k(e, asked, 6).collect()}
    assert got == {**{(0, i): True for i in range(1, 40)}, (200, 206): True, (200, 999): False}
    assert grown[0] == 40 and max(grown[1:]) <= 2


def test_edges_are_moved_once(spark):
    """Edge ids go through one join on their way to a count of neighbours; removed and kept ends are told apart in one pass."""
    n, e = companies(spark)
    lines = lambda df: df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Project" in x and "edge_id" in x for x in lines(algebra.neighbour_counts(e))) <= 2
    left, _ = algebra.remove_rels(n, e, e.where("src = 1").select("edge_id"))
    assert sum("Join " in x for x in lines(left)) == 2
