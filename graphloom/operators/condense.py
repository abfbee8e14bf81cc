"""Strongly connected components, closures by class, and closures that grow with new pairs.

Nodes on a common cycle reach the same nodes, so a transitive closure is that of the graph of its strongly connected components: a
component of n nodes costs n rows instead of its n * n pairs.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import MAX_PAIRS, transitive_closure
from graphloom.sources.tables import cut, drop_path, written

MAX_ROUNDS = 1000
SHRINK = 0.02  # a round that takes less of the edges than this is followed by a colouring


def _pairs(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def _places(edges: DataFrame) -> DataFrame:
    """``(id, n_in, n_out, before, after)`` of every node of the edges; aggregates are combined before the shuffle, so a hub is a row a task."""
    left = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("before"))
    right = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("after"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return left.join(right, "id", "full").select("id", zero("n_in"), zero("n_out"), "before", "after")


def _reduced(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, str]:
    """One round of reduction: ``(edges, passed, path of edges)``.

    A node without an edge in, or without one out, is a component of its own and leaves. A node with one of each is passed over by an
    edge from the node before to the node after it, unless one of these is passed over in this round (the one of lower hash is); ``passed`` is
    ``(id, before, after)``. It is on a cycle exactly where the nodes beside it are in one component.
    """
    places = cut(_places(edges), "scc-places")
    rank: Column = F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), "id")
    single = places.where("n_in = 1 and n_out = 1").select("id", "before", "after", rank.alias("rank"))
    beside = lambda c: single.select(F.col("id").alias(c), F.col("rank").alias(f"{c}_rank"))
    chosen = single.join(beside("before"), "before", "left").join(beside("after"), "after", "left")
    lower = lambda c: F.col(f"{c}_rank").isNull() | (F.col("rank") < F.col(f"{c}_rank"))
    passed = cut(chosen.where(lower("before") & lower("after")).select("id", "before", "after"), "scc-passed")
    gone = cut(passed.select("id").unionByName(places.where("n_in = 0 or n_out = 0").select("id")), "scc-gone")
    over = passed.select(F.col("before").alias("src"), F.col("after").alias("dst")).where("src <> dst")
    stays = edges.unionByName(over).distinct()
    for end in ("src", "dst"):
        stays = stays.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    left, path = written(stays.select("src", "dst"), "scc-edges")
    return left, passed, path


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, colour)``: the highest colour that arrives at each node along the edges. Only nodes whose colour rose send it on."""
    rose = colour
    for _ in range(MAX_ROUNDS):
        sent = edges.join(rose.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("sent"))
        met = colour.join(sent, "id", "left")
        colour = cut(met.select("id", F.greatest("colour", "sent").alias("colour"), (F.coalesce("sent", "colour") > F.col("colour")).alias("rose")), "scc-colour")
        rose = colour.where("rose")
        if rose.isEmpty():
            return colour.select("id", "colour")
    raise RuntimeError(f"colours did not settle in {MAX_ROUNDS} rounds")


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """One round of forward and backward colouring: ``(edges, found, path of edges)``.

    A node's colour is the greatest node that reaches it. Within a colour, the nodes that reach that greatest node are its component: ``found`` is ``(id,
    root)``. At least the component of each colour is found; edges between colours lie in no component and leave.
    """
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    colour = _spread(ids.select("id", F.col("id").alias("colour")), edges)
    of = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour"))
    inner = cut(edges.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")), "scc-inner")
    found = cut(colour.where("id = colour").select("id", F.col("colour").alias("root")), "scc-found")
    front, parts = found, found
    for _ in range(MAX_ROUNDS):
        ahead = inner.join(front.select(F.col("id").alias("dst"), "root"), "dst").select(F.col("src").alias("id"), "root").distinct()
        front = cut(ahead.join(parts, ["id", "root"], "left_anti"), "scc-front")
        if front.isEmpty():
            break
        parts = parts.unionByName(front)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    found = cut(parts, "scc-found")
    rest = inner.select("src", "dst")
    for end in ("src", "dst"):
        rest = rest.join(found.select(F.col("id").alias(end)), end, "left_anti")
    left, path = written(rest, "scc-edges")
    return left, found, path


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` of every node of the edges: nodes that reach one another have one component, its least node. Rows with a null end
    are left out; repeated edges and loops change nothing; an empty table gives none.

    Rounds take off nodes that lie on no cycle and pass over nodes with one edge in and one out, so that paths and long cycles shrink
    by a constant share a round. What resists is coloured forward and backward, in as many rounds as the shortest paths there are long.
    Every round is a table in the shared folder; a component is never gathered in one place.
    """
    every = cut(_pairs(edges, src, dst), "scc-pairs")
    spark = every.sparkSession
    left, path = written(every.where("src <> dst"), "scc-edges")
    size, passed, found = left.count(), [], None
    for seed in range(MAX_ROUNDS):
        if size == 0:
            break
        after, over, new_path = _reduced(left, seed)
        passed.append(over)
        drop_path(spark, path)
        left, path, now = after, new_path, after.count()
        if now and now > size * (1 - SHRINK):
            after, some, new_path = _coloured(left)
            found = some if found is None else found.unionByName(some)
            drop_path(spark, path)
            left, path, now = after, new_path, after.count()
        size = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = cut(found, "scc-roots") if found is not None else every.select(F.col("src").alias("id"), F.col("src").alias("root")).limit(0)
    # nodes passed over, the last first: on a cycle where both sides have one root
    for over in reversed(passed):
        side = lambda c, known=roots: known.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
        root = lambda c: F.coalesce(f"{c}_root", c)
        met = over.join(side("before"), "before", "left").join(side("after"), "after", "left").where(root("before") == root("after"))
        roots = cut(roots.unionByName(met.select("id", root("before").alias("root"))), "scc-roots")
    ids = every.select(F.col("src").alias("id")).unionByName(every.select(F.col("dst").alias("id"))).distinct()
    rooted = ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    return rooted.join(least, "root").select("id", "component")


def condensed_closure(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, reach)``: ``(id, component)`` of :func:`strong_components`, and ``(src, dst)`` of components where one reaches another; a
    component reaches itself where it has a cycle, a loop included."""
    every = cut(_pairs(edges, "src", "dst"), "condensed-pairs")
    members = cut(strong_components(every), "condensed-members")
    of = lambda end: members.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component"))
    between = cut(every.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_component").alias("src"), F.col("dst_component").alias("dst")).distinct(), "condensed-edges")
    cyclic = between.where("src = dst")
    return members, transitive_closure(between.where("src <> dst")).unionByName(cyclic)


def reaches(asked: DataFrame, members: DataFrame, reach: DataFrame) -> DataFrame:
    """``(a, b, reach)`` of pairs ``(a, b)``: whether a path of one edge or more leads from a to b. Nodes that are not in ``members``, and nulls, reach nothing. Repeated
    pairs are each returned."""
    of = lambda end: members.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component"))
    known = asked.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    there = reach.select(F.col("src").alias("a_component"), F.col("dst").alias("b_component"), F.lit(True).alias("there"))
    return known.join(there, ["a_component", "b_component"], "left").select("a", "b", F.coalesce("there", F.lit(False)).alias("reach"))


def closure_pairs(members: DataFrame, reach: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """The ``(src, dst)`` pairs of a closure by class. Their number is known before any is made, and refused beyond ``max_pairs``."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    side = lambda end: sizes.select(F.col("component").alias(end), F.col("n").alias(f"{end}_n"))
    total = reach.join(side("src"), "src").join(side("dst"), "dst").agg(F.sum(F.col("src_n") * F.col("dst_n"))).first()[0] or 0
    if total > max_pairs:
        raise RuntimeError(f"the closure has {total} pairs, more than {max_pairs}; ask for pairs with `reaches`")
    inside = lambda end: members.select(F.col("component").alias(end), F.col("id").alias(f"{end}_id"))
    return reach.join(inside("src"), "src").join(inside("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def _nearest(rows: DataFrame, strict: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` ``(near, far)`` without those that lead on from another one: where ``strict`` has ``(near, x)`` and ``links`` ``(x, far)``."""
    on = strict.select("near", F.col("far").alias("x")).join(links.select(F.col("near").alias("x"), "far"), "x").select("near", "far")
    return rows.join(on, ["near", "far"], "left_anti")


def extend_closure(known: DataFrame, added: DataFrame) -> DataFrame:
    """The ``(src, dst)`` pairs that a stored transitive closure lacks once the pairs ``added`` are there. Rows with a null end are left out.

    A new path goes from an added pair to an added pair, with what was known before, between and behind. Of the closure only the rows that end where
    an added pair starts, or start where one ends, are taken, and of these only those to the nearest start and from the nearest end: one that does not lie
    behind another one on the way. So a pair is met once for each nearest start and end it has (once in a tree), and not for each on its way. Rows
    among starts and ends, with the added pairs, make a small graph whose closure is made as ever; what leads to it and from it is joined to that. Nodes of
    one cycle are never before one another, so each of these stays. The stored closure is read three times (to take those rows, for its
    cycles, and to leave out what it has), as the streamed side of a semi-join, so it moves only where the changes are too large to be sent to it.
    """
    new = cut(_pairs(added, "src", "dst"), "extend-added")
    stored = known.select("src", "dst")
    starts, ends = new.select(F.col("src").alias("x")).distinct(), new.select(F.col("dst").alias("x")).distinct()
    marks = cut(starts.withColumn("s", F.lit(1)).unionByName(ends.withColumn("e", F.lit(1)), allowMissingColumns=True).groupBy("x").agg(F.max("s").alias("s"), F.max("e").alias("e")), "extend-marks")
    there = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    at = lambda end: marks.select(F.col("x").alias(end), there("s").alias(f"{end}_start"), there("e").alias(f"{end}_end"))
    touching = stored.where("src <> dst").join(at("dst"), "dst", "left").join(at("src"), "src", "left").where("dst_start or src_end")
    touching = cut(touching.fillna(False, ["src_start", "src_end", "dst_start", "dst_end"]), "extend-touching")
    # rows whose nodes are on one cycle: the closure has both with themselves
    loops = cut(stored.where("src = dst").select(F.col("src").alias("x")), "extend-loops")
    round_ = touching.select("src", "dst").join(loops.withColumnRenamed("x", "src"), "src", "left_semi").join(loops.withColumnRenamed("x", "dst"), "dst", "left_semi")
    mutual = cut(stored.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(round_, ["src", "dst"], "left_semi"), "extend-mutual")
    strict = touching.join(mutual, ["src", "dst"], "left_anti")
    to = lambda rows, keep: rows.where(keep).select(F.col("src").alias("near"), F.col("dst").alias("far"))
    into = _nearest(to(touching, "dst_start"), to(strict, "dst_start"), to(strict, "dst_start and src_start"))
    back = lambda rows, keep: rows.where(keep).select(F.col("dst").alias("near"), F.col("src").alias("far"))
    out_of = _nearest(back(touching, "src_end"), back(strict, "src_end"), back(strict, "src_end and dst_end"))
    into, out_of = cut(into.select(F.col("near").alias("src"), F.col("far").alias("dst")), "extend-into"), cut(out_of.select(F.col("far").alias("src"), F.col("near").alias("dst")), "extend-out")
    marked, end = marks.select(F.col("x").alias("src")), marks.where("e = 1").select(F.col("x").alias("dst"))
    small = new.unionByName(into.join(marked, "src", "left_semi").select("src", "dst")).unionByName(out_of.join(end, "dst", "left_semi").select("src", "dst"))
    steps = cut(transitive_closure(small).join(end, "dst", "left_semi").select("src", "dst"), "extend-steps")
    mid = lambda c: F.col(c).alias("mid")
    outer = into.join(marked, "src", "left_anti").select("src", mid("dst"))
    led = cut(steps.unionByName(outer.join(steps.select(mid("src"), "dst"), "mid").select("src", "dst").distinct()), "extend-led")
    beyond = out_of.join(end, "dst", "left_anti").select(mid("src"), "dst")
    made = cut(led.unionByName(led.select("src", mid("dst")).join(beyond, "mid").select("src", "dst").distinct()), "extend-made")
    return made.join(stored.join(made, ["src", "dst"], "left_semi"), ["src", "dst"], "left_anti")
