import random

import brute
import pytest

from graphloom.llm import phrases


def random_docs(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé\x1c ") for _ in range(rng.randint(1, 5))) for _ in range(30)]
    passages = [[rng.choice(words) for _ in range(30)] for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [[rng.choice(words) for _ in range(rng.randint(0, 20))] for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts.insert(rng.randint(0, len(parts)), p[rng.randint(0, 8) : len(p) - rng.randint(0, 5)])
        rows.append((i, "".join(w + rng.choice([" ", "\n", " \t "]) for p in parts for w in p)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x " * 300), (n + 3, " x" * 25), (3, rows[3][1]), (None, rows[5][1]), (n + 4, rows[7][1]), (n + 5, "y" * 9000 + " z" * 21)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_removal_equals_brute_force(spark, seed, monkeypatch):
    rows = random_docs(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = phrases.remove_repeated_phrases(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.repeated_words(rows, 20)))


def test_empty_table_and_kept_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_words string")
    assert phrases.remove_repeated_phrases(empty, keep_text="text").columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "text"]
    p = " ".join(f"w{i}" for i in range(20))
    rows = {r.doc_id: r.text for r in phrases.remove_repeated_phrases(spark.createDataFrame([(1, p + "  a"), (2, "b " + p), (3, None)], "doc_id long, text string"), keep_text="text").collect()}
    assert rows == {1: p + " a", 2: "b", 3: None}
