"""Selective blocking for linking: which stored nodes may be as alike to a query node as a threshold asks.

The mean distance of the ``c`` common properties is at most ``m`` (which follows from the threshold), so of any ``j`` of them one is at a
distance of ``c * m / j`` at most: if all were farther, the mean would be too large. Nodes are classed by graph, label and set of property
names, and for each pair of classes the properties to probe and their distance are chosen by how selective the stored values make them. A
value near another shares a signature with it: numbers one of three neighbouring bins, booleans themselves, texts one of the
pieces that a stored text is cut into, of which a few edits leave one whole (partition-based similarity join: Li, Deng, Wang and Feng, 2011).
Pairs that share a signature are candidates; nothing within the threshold is left out, and candidates are scored exactly afterwards.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.similarity import TEXT_CUT
from graphloom.sources.tables import cut

SLACK = 1e-9  # of distances, for the rounding of their means
FOREVER = (1 << 63) - 1
SIGNED_ROWS = 5_000  # query nodes whose signatures one task makes, about
BROAD = 8  # a pair that meets by a signature costs about as much as so many that are scored in place
PAIR = ("gid", "q_names", "d_names")


def reach(st: float, rs: float) -> float:
    """The largest mean distance that gives the similarity ``st``; below 0 if none does."""
    if rs >= 1:
        return 1.0 if st <= 0 else -1.0
    return (1 - rs - st) / (1 - rs)


def names(props: str) -> Column:
    """The names that count, sorted; those that begin with ``_`` do not."""
    return F.array_sort(F.filter(F.map_keys(props), lambda k: ~k.startswith("_")))


def elements(value: Column) -> Column:
    """A property value as an array of single values."""
    one = F.struct(*(value[x].alias(x) for x in ("kind", "num", "str", "bool")))
    return F.when(value["kind"] == "list", value["arr"]).otherwise(F.array(one))


def kinds(value: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(elements(value), lambda x: x["kind"])))


def _kinds_of(rows: DataFrame, *more: str) -> DataFrame:
    """``(gid, label, prop, kinds)`` and ``more`` of every property that has a value, distinct."""
    each = rows.select(*more, "gid", F.explode("labels").alias("label"), "props").select(*more, "gid", "label", F.explode("props").alias("prop", "value"))
    return each.where("NOT startswith(prop, '_')").select(*more, "gid", "label", "prop", kinds(F.col("value")).alias("kinds")).where("size(kinds) > 0").distinct()


APART = "size(array_union(kinds, d_kinds)) > 1"  # kinds that cannot be compared


def clashes(q_nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """``(msg_id, gid)`` of messages with a node that has, beside a stored node of a common label, a property of a kind that cannot be
    compared. ``stored`` may have ``since`` and ``until``: the messages between which a node looks so. Kinds that meet and cannot be compared are
    found first, from a few rows per class, whatever their times."""
    key = ["gid", "label", "prop"]
    mine, other = _kinds_of(q_nodes, "msg_id"), _kinds_of(stored).withColumnRenamed("kinds", "d_kinds")
    bad = mine.select(*key, "kinds").distinct().join(other, key).where(APART)
    if "since" not in stored.columns:
        return mine.join(bad, [*key, "kinds"], "left_semi").select("msg_id", "gid").distinct()
    # only kinds that meet some they cannot be compared with are asked when they were there; what overlaps or follows on is one time
    times = _kinds_of(stored, "since", "until").withColumnRenamed("kinds", "d_kinds").join(bad, [*key, "d_kinds"], "left_semi")
    times = times.select(*key, "d_kinds", F.coalesce("since", F.lit(-FOREVER)).alias("since"), F.coalesce("until", F.lit(FOREVER)).alias("until"))
    order = Window.partitionBy(*key, "d_kinds").orderBy("since", "until")
    times = times.withColumn("upto", F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    times = times.withColumn("n", F.sum(F.coalesce((F.col("since") > F.col("upto")).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    times = times.groupBy(*key, "d_kinds", "n").agg(F.min("since").alias("since"), F.max("until").alias("until"))
    return mine.join(bad, [*key, "kinds"]).join(times, [*key, "d_kinds"]).where("since < msg_id AND until >= msg_id").select("msg_id", "gid").distinct()


def clashing_pairs(q_nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """``(msg_id, gid, q_id, d_id)`` of those pairs. Kinds that meet and cannot be compared are found first, from a few rows per class, and only
    nodes with these are joined."""
    mine, other = _kinds_of(q_nodes, "msg_id", "q_id"), _kinds_of(stored.withColumnRenamed("id", "d_id"), "d_id").withColumnRenamed("kinds", "d_kinds")
    key = ["gid", "label", "prop"]
    bad = mine.select(*key, "kinds").distinct().join(other.select(*key, "d_kinds").distinct(), key).where(APART)
    return mine.join(bad, [*key, "kinds"]).join(other, [*key, "d_kinds"]).select("msg_id", "gid", "q_id", "d_id").distinct()


def _named(stored: DataFrame) -> DataFrame:
    return stored if "names" in stored.columns else stored.withColumn("names", names("props"))


def statistics(stored: DataFrame) -> DataFrame:
    """``(gid, label, names, stats)``: the classes of stored nodes, with a map from each property to what its values in the class are like."""
    rows = _named(stored).select("gid", F.explode("labels").alias("label"), "names", "props")
    values = rows.select("gid", "label", "names", F.explode_outer("props").alias("prop", "value"))
    text = F.substring(F.col("value.str"), 1, TEXT_CUT)
    per = values.groupBy("gid", "label", "names", "prop").agg(
        F.approx_count_distinct(F.coalesce(text, F.col("value.bool").cast("string"), F.col("value.num").cast("string"))).cast("double").alias("distinct"),
        (F.max("value.num") - F.min("value.num")).alias("spread"), F.coalesce(F.avg(F.length(text)), F.lit(0.0)).alias("length"), F.max(F.col("value.kind") == "list").alias("listed"),
    )
    entry = F.struct("prop", F.struct("distinct", "spread", "length", "listed"))
    return per.groupBy("gid", "label", "names").agg(F.map_from_entries(F.filter(F.collect_list(entry), lambda e: e["prop"].isNotNull())).alias("stats"))


def _meets(k: str, d: str) -> str:
    """The share of stored nodes that a probe of property ``k`` within distance ``d`` is thought to meet. It decides what is probed, not what is
    found: a band of a number's range, and the root of a text's distinct values for the pieces that it is cut into."""
    band = f"least(1D, 3 * ({d} / (1 - {d})) / greatest(stats[{k}].spread, 1e-9) + 1 / greatest(stats[{k}].distinct, 1D))"
    piece = f"power(greatest(stats[{k}].distinct, 1D), -1D / (1 + floor({d} * least({TEXT_CUT}, stats[{k}].length / (1 - {d})))))"
    return f"CASE WHEN stats[{k}].listed THEN 0.9D WHEN stats[{k}].spread IS NOT NULL THEN {band} ELSE {piece} END"


def probes(q_nodes: DataFrame, classes: DataFrame, m: float) -> DataFrame:
    """``(gid, label, q_names, d_names, prop, near)``: for each pair of classes the properties to probe, and the distance within which one of them
    is. Of the ways to choose, the one whose probes are thought to meet the fewest. ``prop`` is null where a pair of classes has to meet whole (no
    common property, and a threshold that all reach)."""
    mine = q_nodes.select("gid", F.explode("labels").alias("label"), names("props").alias("q_names")).distinct()
    met = mine.join(classes.withColumnRenamed("names", "d_names"), ["gid", "label"]).withColumn("common", F.array_intersect("q_names", "d_names"))
    if m >= 1 - SLACK:
        return met.select("gid", "label", "q_names", "d_names", F.lit(None).cast("string").alias("prop"), F.lit(1.0).alias("near"))
    # of j probes one is within c * m / j; only distances below 1 tell anything
    way = f"transform(filter(sequence(1, greatest(1, size(common))), j -> size(common) * {m!r}D / j + {SLACK}D < 1), j -> struct(j, size(common) * {m!r}D / j + {SLACK}D AS d))"
    priced = f"transform({way}, w -> struct(w.d AS d, slice(array_sort(transform(common, k -> struct({_meets('k', 'w.d')} AS cost, k))), 1, w.j) AS chosen))"
    best = f"array_min(transform({priced}, w -> struct(aggregate(w.chosen, 0D, (a, x) -> a + x.cost) AS cost, w.d AS d, transform(w.chosen, x -> x.k) AS props)))"
    chosen = met.where("size(common) > 0").withColumn("best", F.expr(best))
    return chosen.select("gid", "label", "q_names", "d_names", F.col("best.d").alias("near"), F.explode("best.props").alias("prop")).select("gid", "label", "q_names", "d_names", "prop", "near")


# Edits that a text of length n may be away, within the relative distance `near`, from one that is longer or not; the pieces it is cut into.
_EDITS = f"cast(floor(near * least({TEXT_CUT}D, {{n}} / (1 - near)) + {SLACK}) AS int)"
_BIN = "rint(x.num / (greatest(near / (1 - near), 1e-9) * (1 + 1e-9)))"


def _of_each(signatures: str) -> Column:
    return F.expr(f"flatten(transform(filter(xs, x -> x.kind IS NOT NULL), x -> coalesce({signatures}, array())))")


def _stored_signatures() -> Column:
    """Of the elements ``xs`` of a stored value: what they are found by."""
    n = "length(y)"
    k = _EDITS.format(n=n)
    start = f"cast(floor(i * {n} / ({k} + 1)) AS int)"
    stop = f"cast(floor((i + 1) * {n} / ({k} + 1)) AS int)"
    pieces = f"IF({n} < {k} + 1, array('t*'), transform(sequence(0, {k}), i -> concat('t', {n}, ':', i, ':', substring(y, {start} + 1, {stop} - {start}))))"
    return _of_each(f"CASE x.kind WHEN 'num' THEN array(concat('n', {_BIN} + 0D)) WHEN 'bool' THEN array(concat('b', x.bool)) ELSE flatten(transform(array(substring(x.str, 1, {TEXT_CUT})), y -> {pieces})) END")


def _query_signatures() -> Column:
    """Of the elements ``xs`` of a query value: all that elements near them may be found by. Of a stored text of each length, the pieces that
    edits leave whole are looked for where as many edits before and behind them as there are can have put them."""
    mine = "length(z)"
    lengths = f"sequence(cast(ceil({mine} * (1 - near) - {SLACK}) AS int), cast(floor(least({TEXT_CUT}D, {mine} / (1 - near)) + {SLACK}) AS int))"
    k = _EDITS.format(n="n")
    start = f"cast(floor(i * n / ({k} + 1)) AS int)"
    size = f"(cast(floor((i + 1) * n / ({k} + 1)) AS int) - {start})"
    low = f"greatest(0, {start} - i, {start} + ({mine} - n) - ({k} - i))"
    high = f"least({mine} - {size}, {start} + i, {start} + ({mine} - n) + ({k} - i))"
    places = f"IF({low} > {high}, array(), transform(sequence({low}, greatest({low}, {high})), p -> concat('t', n, ':', i, ':', substring(z, p + 1, {size}))))"
    pieces = f"IF(n < {k} + 1, array('t*'), flatten(transform(sequence(0, {k}), i -> {places})))"
    text = f"array_distinct(flatten(flatten(transform(array(substring(x.str, 1, {TEXT_CUT})), z -> transform({lengths}, n -> {pieces})))))"
    bins = f"transform(array(-1, 0, 1), o -> concat('n', {_BIN} + o + 0D))"
    return _of_each(f"CASE x.kind WHEN 'num' THEN {bins} WHEN 'bool' THEN array(concat('b', x.bool)) ELSE {text} END")


def candidate_pairs(q_nodes: DataFrame, stored: DataFrame, st: float, rs: float = 0.0) -> DataFrame:
    """``(msg_id, gid, q_id, d_id)``, distinct: all pairs of a common label that may have the similarity ``st``, and others.

    A stored node may come in several rows, which say each what its ``names`` may be beside a part of its ``props``; and with ``since``, the message
    after which it is there (null: always).

    Signatures are joined without the nodes' properties: a stored node costs a few short rows per probed property, a query node some tens.
    """
    m = reach(st, rs)
    if m < 0:
        return q_nodes.select("msg_id", "gid", "q_id", F.lit(0).cast("long").alias("d_id")).limit(0)
    plan = cut(probes(q_nodes, statistics(stored), m), "link-probes")
    return _meeting(*_signed(q_nodes, stored, plan))


def split_pairs(q_nodes: DataFrame, stored: DataFrame, st: float, rs: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """``(pairs, broad)``: of :func:`candidate_pairs` those of pairs of classes that signatures tell apart, and ``(gid, label, q_names, d_names)`` of
    the others, whose nodes share signatures with more than one of ``BROAD`` of all they could meet: these cost less when every pair is scored.

    What would meet is counted from the frequencies of signatures, before any pair is made. A pair of nodes has one pair of sets of names, so
    it is on one side only, whatever labels it has in common.
    """
    m = reach(st, rs)
    plan = cut(probes(q_nodes, statistics(stored), m) if m >= 0 else probes(q_nodes, statistics(stored), 0.0).limit(0), "link-probes")
    q, d = (cut(x, "link-signed") for x in _signed(q_nodes, stored, plan, True))
    here, there = q.groupBy("gid", "slot", "signature", "pair").agg(F.count(F.lit(1)).alias("nq")), d.groupBy("gid", "slot", "signature").agg(F.count(F.lit(1)).alias("nd"))
    met = here.join(there, ["gid", "slot", "signature"]).groupBy("pair").agg(F.sum(F.col("nq").cast("double") * F.col("nd")).alias("met"))
    nq = q_nodes.select("gid", F.explode("labels").alias("label"), names("props").alias("q_names")).groupBy("gid", "label", "q_names").agg(F.count(F.lit(1)).alias("nq"))
    nd = _named(stored).select("gid", F.explode("labels").alias("label"), F.col("names").alias("d_names")).groupBy("gid", "label", "d_names").agg(F.count(F.lit(1)).alias("nd"))
    classes = plan.select("gid", "label", "q_names", "d_names").distinct().join(nq, ["gid", "label", "q_names"]).join(nd, ["gid", "label", "d_names"])
    classes = classes.withColumn("pair", F.xxhash64(*PAIR))
    total = classes.groupBy("pair").agg(F.sum(F.col("nq").cast("double") * F.col("nd")).alias("total"))
    broad = total.join(met, "pair").where(F.col("met") * BROAD > F.col("total")).select("pair")
    broad = cut(classes.join(broad, "pair").select("pair", "gid", "label", "q_names", "d_names"), "link-broad")
    return _meeting(q.join(broad.select("pair").distinct(), "pair", "left_anti"), d), broad.drop("pair")


def _signed(q_nodes: DataFrame, stored: DataFrame, plan: DataFrame, paired: bool = False) -> tuple[DataFrame, DataFrame]:
    """The signatures of both sides, by slot; those of query nodes with the hash of their pair of sets of names, if asked."""
    slot = F.xxhash64("gid", "label", "d_names", "prop", "near").alias("slot")
    q = q_nodes.select("msg_id", "gid", "q_id", "props", names("props").alias("q_names"), F.explode("labels").alias("label")).join(plan, ["gid", "label", "q_names"])
    late = ["since"] if "since" in stored.columns else []
    d = _named(stored).select("gid", F.col("id").alias("d_id"), "props", F.col("names").alias("d_names"), *late, F.explode("labels").alias("label")).join(plan.drop("q_names").distinct(), ["gid", "label", "d_names"])

    def signed(rows: DataFrame, signatures: Column, *keys: str) -> DataFrame:
        each = rows.where("prop IS NOT NULL").select(*keys, slot, "near", elements(F.element_at("props", F.col("prop"))).alias("xs"))
        some = each.select(*keys, "slot", F.explode(F.array_distinct(signatures)).alias("signature"))
        return some.unionByName(rows.where("prop IS NULL").select(*keys, slot, F.lit("").alias("signature")))

    # A query node is one row and has its signatures once in each slot; they are many, so its rows are spread first. A stored node may come in several.
    tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), q_nodes.count() // SIGNED_ROWS)
    q = q.repartition(tasks, "msg_id", "gid", "q_id")
    pair = ["pair"] if paired else []
    q = q.withColumn("pair", F.xxhash64(*PAIR)) if paired else q
    return signed(q, _query_signatures(), "msg_id", "gid", "q_id", *pair), signed(d, _stored_signatures(), "gid", "d_id", *late).distinct()


def _meeting(q: DataFrame, d: DataFrame) -> DataFrame:
    met = q.join(d, ["gid", "slot", "signature"])
    return (met.where("since IS NULL OR since < msg_id") if "since" in d.columns else met).select("msg_id", "gid", "q_id", "d_id").distinct()


def as_of(asked: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``asked`` (msg_id, gid, d_id, ``keys`` and more) with the ``value`` that its message meets: that of the last of ``values`` (gid, id, ``keys``,
    since, ``value``) before it. Rows that there is nothing for yet are left out. One sort of both together, so a node with many of either costs
    no more than their sum."""
    by = ["gid", "d_id", *keys]
    more = [c for c in asked.columns if c not in by]
    kept = F.struct(*more)
    rows = values.select("gid", F.col("id").alias("d_id"), *keys, "since", F.lit(0).alias("at"), F.lit(None).cast(asked.select(kept.alias("x")).schema["x"].dataType).alias("ask"), F.struct(value).alias("v"))
    asks = asked.select(*by, F.col("msg_id").alias("since"), F.lit(-1).alias("at"), kept.alias("ask"), F.lit(None).cast(rows.schema["v"].dataType).alias("v"))
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_first("since"), "at").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.unionByName(asks).withColumn("v", F.last("v", True).over(order)).where("at = -1 AND v IS NOT NULL")
    return met.select(*by, "ask.*", f"v.{value}")
