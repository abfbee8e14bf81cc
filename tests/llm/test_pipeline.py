import corpus_pipeline as cp


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def corpus():
    en = ["the", "and", "of", "with", "this", "that", "reading", "writes", "whether"]
    de = ["der", "und", "mit", "nicht", "über", "zwischen", "schön", "ungefähr"]
    rows = []
    for i in range(120):
        words, lang = (en, "en") if i % 2 else (de, "de")
        text = " ".join(words[(i * 7 + j * j * (1 + i % 5) + j // 3) % len(words)] + (str(i * j % 17) if j % 4 == 0 else "") for j in range(60))
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [(200, rows[5][1], "en", "s1", 0), (201, rows[6][1] + " zwischen", "de", "s0", 0), (202, None, None, None, None), (203, "", "en", "s0", 0), (204, "12 34", None, "s0", 5)]
    return rows


def test_stages_and_run(spark, tmp_path):
    docs = table(spark, corpus())
    told = cp.language_id(spark, docs, "")
    ids = {r.doc_id for r in told.collect()}
    assert told.columns == cp.COLUMNS and not ids & {202, 203, 204} and set(range(120)) <= ids
    near = cp.near_duplicates(spark, told, "")
    left = {r.doc_id for r in near.collect()}
    assert 5 in left and 6 in left and not left & {200, 201}
    cut = cp.repeated_passages(spark, near, "")
    assert cut.columns == cp.COLUMNS and {r.doc_id for r in cut.collect()} <= left
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = cp.run(spark, str(tmp_path)).collect()
    assert rows and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)


def test_empty_table(spark):
    docs = table(spark, [])
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_stages_equal_brute_force(spark):
    """Each stage on what the one before kept, with a very long text, repeated rows and columns that operators also use."""
    import hashlib

    import brute
    from sentencepiece import SentencePieceProcessor

    from graphloom.llm import mixing, sentencepiece_backend

    rows = corpus()
    passage = " ".join(f"shared{i}" for i in range(12))
    rows += [(300, rows[9][1][:150] + " " + passage, "en", "s2", 0), (301, passage + " " + " ".join(f"{w}{i}" for i, w in enumerate(rows[11][1].split())), "en", None, 0)]
    rows += [(302, " ".join(f"{w}{i % 977}" for i, w in enumerate(rows[13][1].split() * 3000)), "en", "s2", 0), rows[20], rows[21], (None, rows[22][1] + " mit", "de", "s1", 0)]
    docs = table(spark, rows).selectExpr("*", "'x' as class_id", "1 as topic", "'y' as score", "2 as token_ids", "true as kept", "3 as n_removed")
    told = cp.language_id(spark, docs, "")
    judged = [tuple(r) for r in told.collect()]
    assert len(judged) == len(rows) - 3
    # one of each group of near copies, and rows without an id
    sets = [brute.shingles(t) for _, t, *_ in judged]
    links = [(i, j) for i in range(len(judged)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = brute.components(range(len(judged)), links)
    least = {}
    for i, (d, *_) in enumerate(judged):
        least[group[i]] = min(least.get(group[i], 10**9), 10**9 if d is None else d)
    want = {(d, t) for i, (d, t, *_) in enumerate(judged) if d is None or d == least[group[i]]}
    clash = lambda df: df.selectExpr("*", "'x' as class_id", "1 as topic", "'y' as score", "true as kept", "3 as n_removed", "'z' as weight")
    near = [tuple(r) for r in cp.near_duplicates(spark, clash(table(spark, judged)), "").collect()]
    assert sorted(map(str, ((d, t) for d, t, *_ in near))) == sorted(map(str, want))
    cut = [tuple(r) for r in cp.repeated_passages(spark, clash(table(spark, near)), "").collect()]
    plain = {str(d): (n, gone, sha) for d, n, gone, _, sha in brute.repeated_bytes([(d, t) for d, t, *_ in near if d != 302], 50)}
    got = {str(d): t for d, t, *_ in cut}
    assert set(got) - {"302"} == {d for d, (n, gone, _) in plain.items() if not gone or gone < n} and passage[10:40] not in got["301"]
    assert all(hashlib.sha256(t.encode()).hexdigest() == plain[d][2] for d, t in got.items() if d != "302" and t.isascii())
    mixed = cp.source_mixing(spark, clash(table(spark, cut)), "")
    chosen = {(r.doc_id, r.text) for r in mixed.collect()}
    rule = {(r.doc_id, r.text) for r in mixing.mix(table(spark, cut)).collect() if r.sampled}
    assert chosen == rule and chosen <= {(d, t) for d, t, *_ in cut} and mixed.columns == cp.COLUMNS
    reference = SentencePieceProcessor(model_file=sentencepiece_backend.DEFAULT_MODEL)
    for r in cp.encode(spark, clash(mixed), "").collect():
        (text,) = [t for d, t in chosen if d == r.doc_id]
        assert r.parity and r.round_trip and list(r.token_ids) == reference.encode(text)
