import pytest
from graphs import companies, make, node, pairs
from pyspark.sql import functions as F

from graphloom.model import label_edges
from graphloom.operators import closure, views
from graphloom.plans import config
from graphloom.plans.config import Hop, Rel, ViewConfig, VRel
from graphloom.sources import tables

PARTNERS = VRel("VREL", Hop("founder", "Company", "Person"), Hop("founder", "Company", "Person", True))


def test_vrel_of_shared_founder(spark):
    n, e = companies(spark)
    le = label_edges(n, e)
    got = views.compose_vrel(le, PARTNERS)
    assert pairs(got) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert pairs(closure.closure_delta(got, True, False)) == []
    assert pairs(closure.closure_delta(got, True, True)) == [(1, 1), (1, 3), (2, 2), (3, 1), (3, 3)]
    assert pairs(closure.closure_delta(got, False, False)) == []


def test_one_edge_is_not_two_hops(spark):
    vrel = VRel("V", Hop("cooperate", "C", "C"), Hop("cooperate", "C", "C"))
    n, e = make(spark, [node(1, "C"), node(2, "C")], [(1, "cooperate", 2), (2, "cooperate", 1)])
    assert pairs(views.compose_vrel(label_edges(n, e), vrel)) == [(1, 1), (2, 2)]
    n, e = make(spark, [node(1, "C"), node(2, "C")], [(1, "cooperate", 2)])
    assert pairs(views.compose_vrel(label_edges(n, e), vrel)) == []
    n, e = make(spark, [node(1, "C")], [(1, "cooperate", 1)])
    assert pairs(views.compose_vrel(label_edges(n, e), vrel)) == []
    n, e = make(spark, [node(1, "C")], [(1, "cooperate", 1), (1, "cooperate", 1)])
    assert pairs(views.compose_vrel(label_edges(n, e), vrel)) == [(1, 1)]
    mirror = VRel("V", Hop("cooperate", "C", "C"), Hop("cooperate", "C", "C", True))
    n, e = make(spark, [node(1, "C"), node(2, "C")], [(1, "cooperate", 2), (1, "cooperate", 2)])
    assert pairs(views.compose_vrel(label_edges(n, e), mirror)) == [(1, 1)]


def test_a_hub_is_dealt_into_tiles(spark, monkeypatch):
    """All pairs of a hub, each once, by many tasks; and a second edge alone makes a node its own partner."""
    monkeypatch.setattr(views, "TILE", 8)
    n, e = make(spark, [node(i, "C") for i in range(60)] + [node(100, "N"), node(101, "N")], [(i, "in", 100 if i < 50 else 101) for i in range(60)] + [(7, "in", 100)])
    vrel = VRel("V", Hop("in", "C", "N"), Hop("in", "C", "N", True))
    got = views.compose_vrel(label_edges(n, e).coalesce(1), vrel)
    want = [(a, b) for a in range(60) for b in range(60) if (a < 50) == (b < 50) and (a != b or a == 7)]
    assert pairs(got) == want
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 3 and max(sizes) < 1300


def test_full_view_equals_base_and_expansion(spark):
    n, e = companies(spark)
    base = ViewConfig(("Company", "Person"), (Rel("founder", ("Company",), ("Person",)),))
    second = VRel("NEXT", Hop("VREL", "Company", "Company"), Hop("founder", "Company", "Person"))
    whole = ViewConfig(base.labels, base.rels, (second, VRel("VREL", PARTNERS.first, PARTNERS.second, True, True)))
    nodes, full = views.gen_view(n, e, whole)
    base_nodes, base_edges = views.gen_view(n, e, base)
    step = views.expand_view(base_nodes, base_edges, base, whole)
    rows = lambda df: sorted((r.src, r.dst, r.type, r.provenance) for r in df.collect())
    assert rows(full) == rows(step)
    assert nodes.count() == 5 and {r.realId for r in nodes.collect()} == {1, 2, 3, 11, 12}
    by = lambda t: {(a, b) for a, b, x, _ in rows(full) if x == t}
    assert by("NEXT") == {(a, b) for a in (1, 2, 3) for b in (11, 12)} and len(by("VREL")) == 9


def test_relations_outside_the_view(spark):
    n, e = companies(spark)
    le, only = label_edges(n, e), views.copy_view_nodes(n, ["Company"])
    rels = [Rel("founder", ("Company",), ("Person",))]
    assert views.view_rels(le, only, rels).count() == 0
    with pytest.raises(ValueError):
        views.view_rels(le, only, rels, strict=True)
    assert views.view_rels(le, only, []).count() == 0
    assert pairs(views.extract_rels(le, "founder", ["Person"], ["Company"])) == []


def test_config_order_and_round_trip():
    hop = lambda t: Hop(t, "A", "A")
    a, b, c = VRel("a", hop("b"), hop("x")), VRel("b", hop("x"), hop("x")), VRel("c", hop("c"), hop("x"))
    assert config.ordered((a, b, c)) == [[b, c], [a]]
    with pytest.raises(ValueError):
        config.ordered((a, VRel("b", hop("a"), hop("x"))))
    whole = ViewConfig(("A", "人物"), (Rel("x", ("A",), ("A",), True, False),), (a, b))
    assert config.parse(config.dump(whole)) == whole
    assert config.new_vrels(ViewConfig((), (), (a, b)), ViewConfig((), (), (a, a, c))) == (a, c)


@pytest.mark.parametrize("second", [Hop("a", "C", "C", True), Hop("b", "C", "C"), Hop("b", "C", "C", True), Hop("a", "C", "C")])
def test_pairs_come_once_whatever_the_number_of_middle_nodes(spark, second):
    """Nodes with one middle node and with several, loops and parallel edges, against all pairs of edges."""
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(12), rng.choice("ab"), rng.randrange(12)) for _ in range(40)] + [(3, "a", 3), (1, "a", 2), (1, "a", 2), (50, "a", 51), (52, "a", 51), (51, "b", 53)]
    n, e = make(spark, [node(i, "C") for i in (*range(12), 50, 51, 52, 53)], rows)
    first = Hop("a", "C", "C")
    edges = [(i, s, t, d) for i, (s, t, d) in enumerate(rows)]
    turned = [(i, d, s) if second.inverse else (i, s, d) for i, s, t, d in edges if t == second.type]
    want = {(s, d) for i, s, t, m in edges if t == "a" for j, m2, d in turned if m2 == m and i != j}
    assert pairs(views.compose_vrel(label_edges(n, e), VRel("V", first, second))) == sorted(want)


def test_shuffles_begin_with_parts_by_input(spark, tmp_path, monkeypatch):
    """A larger input has more tasks, not larger ones, whatever the session's number of partitions; a small one has that number."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    small = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    path = str(tmp_path / "rows")
    spark.range(50_000).withColumn("x", F.xxhash64("id")).write.parquet(path)
    try:
        tables.sized(spark, path)
        assert spark.conf.get(name) == spark.conf.get("spark.sql.shuffle.partitions")
        monkeypatch.setattr(tables, "PART_BYTES", 10_000)
        tables.sized(spark, path)
        for x in small:
            spark.conf.set(x, "1b")
        spread = spark.read.parquet(path).groupBy("x").count().groupBy(F.spark_partition_id()).count().collect()
        assert len(spread) > 30 and max(r["count"] for r in spread) < 2500
    finally:
        for x in (name, *small):
            spark.conf.unset(x)
