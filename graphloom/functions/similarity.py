"""Distances of property values and similarity of nodes, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_CUT = 20  # characters of a text that count


def numeric_dist(a: Column, b: Column) -> Column:
    return 1 - 1 / (1 + F.abs(a - b))


def text_dist(a: Column, b: Column) -> Column:
    """Edit distance of the first characters over the longer length; 0 for two empty texts."""
    x, y = F.substring(a, 1, TEXT_CUT), F.substring(b, 1, TEXT_CUT)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.try_divide(F.levenshtein(x, y), longer))


def categorical_dist(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(0.0)).otherwise(F.lit(1.0))


def alias_dist(a: Column, b: Column) -> Column:
    """Least uncut edit distance over longer length, of two arrays of names; 1 if either is empty."""
    one = lambda x, y: F.when(F.greatest(F.length(x), F.length(y)) == 0, F.lit(0.0)).otherwise(F.try_divide(F.levenshtein(x, y), F.greatest(F.length(x), F.length(y))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(1.0)).otherwise(F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: one(x, y))))))


def single_dist(a: Column, b: Column) -> Column:
    """Distance of two single values; null where their kinds cannot be compared."""
    kind = lambda k: (a["kind"] == k) & (b["kind"] == k)
    return F.when(kind("num"), numeric_dist(a["num"], b["num"])).when(kind("str"), text_dist(a["str"], b["str"])).when(kind("bool"), categorical_dist(a["bool"], b["bool"]))


def _as_list(v: Column) -> Column:
    return F.when(v["kind"] == "list", v["arr"]).otherwise(F.array(F.struct(v["kind"].alias("kind"), v["num"].alias("num"), v["str"].alias("str"), v["bool"].alias("bool"))))


def prop_dist(a: Column, b: Column, compat_list_dist: bool = False) -> Column:
    """Distance of two property values. A list against anything: the least over pairs, 1 if either list is empty; pairs that cannot
    be compared make it null, as single values that cannot be compared do. With ``compat_list_dist`` two lists with items are at 0."""
    x, y = _as_list(a), _as_list(b)
    grid = F.flatten(F.transform(x, lambda s: F.transform(y, lambda t: single_dist(s, t))))
    empty = (F.size(x) == 0) | (F.size(y) == 0)
    least = F.lit(0.0) if compat_list_dist else F.when(F.exists(grid, lambda d: d.isNull()), F.lit(None).cast("double")).otherwise(F.array_min(grid))
    lists = F.when(empty, F.lit(1.0)).otherwise(least)
    return F.when((a["kind"] == "list") | (b["kind"] == "list"), lists).otherwise(single_dist(a, b))


def node_similarity(mean_dist: Column, rs: float = 0.0) -> Column:
    """1 less a mix of a structural distance of 1 and the mean distance of properties."""
    return 1 - (F.lit(float(rs)) + (1 - float(rs)) * mean_dist)


def least_text_dist(a: Column, b: Column) -> Column:
    """A lower bound of :func:`text_dist` from lengths alone."""
    x, y = F.least(F.length(a), F.lit(TEXT_CUT)), F.least(F.length(b), F.lit(TEXT_CUT))
    return F.coalesce(F.try_divide(F.abs(x - y), F.greatest(x, y)), F.lit(0.0))
