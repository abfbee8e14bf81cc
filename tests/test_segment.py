import math
import random

from graphs import make
from pyspark.sql import functions as F

from graphloom.functions import segment
from graphloom.functions.keywords import edge_keywords

TEXT = lambda x: {"kind": "str", "num": None, "str": x, "bool": None, "arr": None}


def paths(run, lexicon, least, longest):
    """All paths: (sum of scores, words)."""
    if not run:
        return [(0.0, [])]
    out = []
    for k in range(1, min(longest, len(run)) + 1):
        score = lexicon.get(run[:k], least if k == 1 else None)
        if score is not None:
            out += [(score + s, [run[:k], *w]) for s, w in paths(run[k:], lexicon, least, longest)]
    return out


def test_best_path_against_all_paths(spark):
    rng = random.Random(5)
    lexicon = {"".join(rng.choices("甲乙丙𠀀", k=rng.randint(1, 4))): -rng.random() * 9 for _ in range(60)}
    runs = {"".join(rng.choices("甲乙丙𠀀丁", k=rng.randint(1, 11))) for _ in range(60)} | {"", "甲" * 3000}
    table = spark.createDataFrame([(r,) for r in [*runs, *runs, None]], "run string")
    got = {r.run: r.words for r in segment.segment(table, spark.createDataFrame(list(lexicon.items()), "word string, score double")).collect()}
    assert set(got) == runs - {""}
    least = min(lexicon.values()) - 1
    for run, words in got.items():
        assert "".join(words) == run
        if len(run) < 20:
            best = max(paths(run, lexicon, least, 4))[0]
            assert math.isclose(sum(lexicon.get(w, least) for w in words), best, abs_tol=1e-6)


def test_ties_take_fewer_words_then_a_shorter_last_one(spark):
    lexicon = spark.createDataFrame([("甲", -1.0), ("甲甲", -2.0)], "word string, score double")
    got = segment.segment(spark.createDataFrame([("甲甲甲",)], "run string"), lexicon).first().words
    assert got == ["甲甲", "甲"]


def test_learned_words(spark):
    """Runs of random words come apart where they were put together."""
    rng = random.Random(3)
    signs = [chr(0x4E00 + i) for i in range(400)]
    words = list({"".join(rng.sample(signs, rng.choice([1, 2, 2, 2, 3]))) for _ in range(150)})
    weights = [1 / (i + 3) for i in range(len(words))]
    lines = [rng.choices(words, weights, k=rng.randint(3, 20)) for _ in range(1500)]
    texts = spark.createDataFrame([("x " + "".join(w) + ", y",) for w in lines] + [(None,), ("",), ("plain words",)], "text string")
    lexicon = segment.learn(texts)
    assert abs(lexicon.agg(F.sum(F.exp("score"))).first()[0] - 1) < 1e-9
    got = {r.run: r.words for r in segment.segment(texts.select(F.explode(segment.runs_of(F.col("text"))).alias("run")), lexicon).collect()}

    def cuts(words):
        at, out = 0, set()
        for w in words:
            at += len(w)
            out.add(at)
        return out

    hit = told = true = 0
    for w in lines:
        a, b = cuts(w), cuts(got["".join(w)])
        hit, told, true = hit + len(a & b), told + len(b), true + len(a)
    assert hit / told > 0.95 and hit / true > 0.95
    assert segment.learn(texts.where("text = ''")).count() == 0


def test_keywords_of_a_script_without_spaces(spark):
    lexicon = spark.createDataFrame([("东京", -1.0), ("大学", -1.0), ("东", -4.0)], "word string, score double")
    nodes, edges = make(spark, [(1, ["P"], {"name": TEXT("东京大学 abc东京")}), (2, ["Q"], {"name": TEXT("ann bo")})], [(1, "r", 2)])
    name, bag = ["东京大学 abc东京", "ann bo"], ["东京", "大学", "abc", "ann", "bo"]
    assert edge_keywords(nodes, edges, lexicon).first().keywords == sorted(["P", "Q", *name, *bag, "P", "P", *name, *bag, "东京"])
    assert edge_keywords(nodes, edges, lexicon.limit(0)).first().keywords.count("京") == 3  # single characters where nothing is known
