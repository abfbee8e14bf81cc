"""A bag of keywords for each edge, from the labels, names and words of the properties of its ends."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.segment import LONGEST, SPACELESS, segment
from graphloom.sources.tables import cut

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def property_words(props: Column) -> Column:
    """The distinct words of all text properties, and of the texts in lists."""
    texts = F.flatten(F.transform(F.map_values(props), lambda v: F.when(v["kind"] == "list", F.transform(v["arr"], lambda x: x["str"])).otherwise(F.array(v["str"]))))
    return F.array_distinct(words(F.array_join(texts, " ")))


def names(props: Column) -> Column:
    """The names of a node, trimmed, without blanks: one, or the texts of a list."""
    name = props["name"]
    some = F.when(name["kind"] == "list", F.transform(name["arr"], lambda x: F.trim(x["str"]))).otherwise(F.array(F.trim(name["str"])))
    return F.filter(F.coalesce(some, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def segmented_words(bags: DataFrame, lexicon: DataFrame, script: str = SPACELESS, longest: int = LONGEST) -> DataFrame:
    """``bags`` (id, words, name_words) with the stretches of a script without spaces put as the words that a lexicon finds in them
    (:func:`graphloom.functions.segment.learn`). Only words that have such stretches are moved."""
    parts = lambda c: F.flatten(F.transform(c, lambda w: F.regexp_extract_all(w, F.lit(f"{script}|(?:(?!{script}).)+"), F.lit(0))))
    plain = lambda c: F.filter(c, lambda w: ~w.rlike(script))
    runs = lambda c: F.filter(c, lambda w: w.rlike(script))
    bags = bags.withColumns({c: parts(F.col(c)) for c in ("words", "name_words")})
    in_bag = lambda c: F.transform(runs(F.col(c)), lambda w: F.struct(F.lit(c).alias("bag"), w.alias("run")))
    asked = bags.select("id", F.explode(F.concat(in_bag("words"), in_bag("name_words"))).alias("a")).select("id", "a.*")
    asked = cut(asked, "keyword-runs")
    found = asked.join(segment(asked.select("run"), lexicon, longest).withColumnRenamed("words", "found"), "run")
    pick = lambda bag: F.flatten(F.collect_list(F.when(F.col("bag") == bag, F.col("found"))))
    told = found.groupBy("id").agg(pick("words").alias("w"), pick("name_words").alias("nw"))
    both = lambda c, more: F.concat(plain(F.col(c)), F.coalesce(more, F.array().cast("array<string>")))
    rest = [c for c in bags.columns if c not in ("id", "words", "name_words")]
    return bags.join(told, "id", "left").select("id", *rest, F.array_distinct(both("words", F.col("w"))).alias("words"), both("name_words", F.col("nw")).alias("name_words"))


def edge_keywords(nodes: DataFrame, edges: DataFrame, lexicon: DataFrame | None = None, script: str = SPACELESS, longest: int = LONGEST) -> DataFrame:
    """``(edge_id, keywords)``: once each the labels and names of both ends and the words of all their properties; then the start's labels
    twice, the names of both once and the words of these once (a name may be a list of names). Blanks are left out; sorted, as a bag has no order.
    With a ``lexicon`` stretches of a script without spaces are several words, else one."""
    ends = nodes.select("id", "labels", names(F.col("props")).alias("names"), property_words(F.col("props")).alias("words"))
    ends = ends.withColumn("name_words", words(F.array_join("names", " ")))
    if lexicon is not None:
        ends = segmented_words(ends, lexicon, script, longest)
    # what a node gives to an edge is put together once per node: its distinct words, and what it adds as a start and as an end
    own = F.array_distinct(F.concat("labels", "names", "words"))
    side = lambda end, i, *again: ends.select(F.col("id").alias(end), own.alias(f"own{i}"), F.concat(*again, "names", "name_words").alias(f"again{i}"))
    bag = F.concat(F.array_union("own1", "own2"), "again1", "again2")
    return edges.join(side("src", 1, "labels", "labels"), "src").join(side("dst", 2), "dst").select("edge_id", F.sort_array(bag).alias("keywords"))
