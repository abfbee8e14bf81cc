import os
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import sentencepiece_backend as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.DEFAULT_MODEL), reason="no tokenizer files")
TEXTS = ["", " ", "  two  spaces ", "a\tb\n\nc", "日本語 é \U0001f600\x00", "▁ real ▁▁ marks", "</s> <unk> <0x41>", "x" * 5000, "word " * 20_000, "é"]


@pytest.fixture(scope="module")
def tool():
    return sp.Codec(sp.DEFAULT_MODEL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_parity(texts):
    tool = sp.codec(sp.DEFAULT_MODEL)
    flat, counts = tool.encode(texts)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        assert flat[at : at + n].tolist() == tool.oracle.encode(t)
        assert tool.decode(flat[at : at + n]) == t.replace("▁", " ")
        at += n


def test_fixed_texts_and_forgetting(tool, monkeypatch):
    monkeypatch.setattr(sp, "KEPT_CHARS", 12)
    for t in TEXTS * 2:
        flat, counts = tool.encode([t])
        assert flat.tolist() == tool.oracle.encode(t) and counts.tolist() == [len(flat)]


def test_words_share_sequences(monkeypatch):
    tool, sent = sp.Codec(sp.DEFAULT_MODEL), []
    told = tool.encode_units
    monkeypatch.setattr(tool, "encode_units", lambda units: sent.extend(units) or told(units))
    text = " ".join(f"w{i}ord é{i * 7919}" for i in range(5000))
    flat, counts = tool.encode([text, text[:1000]])
    assert flat[: counts[0]].tolist() == tool.oracle.encode(text) and flat[counts[0] :].tolist() == tool.oracle.encode(text[:1000])
    assert 1 < len(sent) < 100  # of 10,000 distinct words


@pytest.mark.parametrize("section", [1, 8, 4096])
def test_texts_of_one_batch(tool, monkeypatch, section):
    monkeypatch.setattr(sp, "SECTION_BYTES", section)
    monkeypatch.setattr(sp, "KEPT_CHARS", 3 * section)
    texts = ["left out", *TEXTS, None, "ends  ", " a", "▁", "", None, "▁▁a▁", "a", *TEXTS[::-1]]
    for kind in (pa.string(), pa.large_string()):
        flat, counts = tool.encode(pa.array(texts, kind)[1:])
        assert counts.sum() == len(flat)
        for t, ids in zip(texts[1:], [p.tolist() for p in np.split(flat, np.cumsum(counts)[:-1])], strict=True):
            assert ids == (tool.oracle.encode(t) if t else []), t
    for none in ([], [""], pa.array([None], pa.string())):
        flat, counts = tool.encode(none)
        assert flat.tolist() == [] and counts.tolist() == [0] * len(none)


@given(st.lists(st.text("▁ab é", max_size=9), max_size=5))
def test_units(texts):
    got, per_text = sp.units(pa.array(texts, pa.string()))
    want = [re.findall("▁*[^▁]+|▁+", t) for t in texts]
    assert got.to_pylist() == sum(want, []) and per_text.tolist() == list(map(len, want))


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("pieces", [["▁", "a", "b", "ab", "▁a", "▁ab", "▁▁", "▁▁a"], ["a", "b", "ab"], ["▁", "a", "b", "a▁", "b▁a", "▁b"]])
def test_models_whose_words_may_not_be_joined(tmp_path, prefix, pieces):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.trainer_spec.model_type = sp.BPE
    model.trainer_spec.byte_fallback = True
    model.normalizer_spec.add_dummy_prefix = prefix
    model.normalizer_spec.escape_whitespaces = True
    model.normalizer_spec.remove_extra_whitespaces = False
    for piece, kind in [("<unk>", sp.UNKNOWN), ("<s>", sp.CONTROL), ("</s>", sp.CONTROL), *((f"<0x{i:02X}>", sp.BYTE) for i in range(256))]:
        model.pieces.add(piece=piece, score=0, type=kind)
    for i, piece in enumerate(pieces):
        model.pieces.add(piece=piece, score=-i, type=sp.NORMAL)
    path = tmp_path / "b.model"
    path.write_bytes(model.SerializeToString())
    tool = sp.Codec(str(path))
    texts = ["ab", "", "b ab a", "  aab  ", "a  b", " ", "é ab"]
    flat, counts = tool.encode(texts)
    for t, ids in zip(texts, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        assert ids.tolist() == tool.oracle.encode(t), t


def test_table(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(99, None, "clash"), (0, "", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(2)
    out = sp.encode(docs, check_one_in=1)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "token_ids", "n_tokens", "parity", "round_trip"]
    null = next(r for r in got if r.doc_id == 99)
    assert null.token_ids is None and null.n_tokens is None and null.parity is None and null.round_trip is None
    assert all(r.parity and r.n_tokens == len(r.token_ids) and r.round_trip == ("▁" not in r.text) for r in got if r.doc_id != 99)
    back = {r.doc_id: r.decoded for r in sp.decode(out).collect()}
    assert all(back[r.doc_id] == r.text.replace("▁", " ") for r in got if r.doc_id != 99) and back[99] is None
    assert sp.encode(docs.limit(0)).count() == 0


def test_every_text_is_compared(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(40)] + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for got in (sp.encode(docs), sp.op8_sentencepiece(spark, str(tmp_path))):
        assert {r.doc_id: r.parity for r in got.collect()} == dict.fromkeys(range(40), True) | {99: None}


def test_unigram_model_is_rebuilt(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.trainer_spec.model_type = sp.UNIGRAM
    model.trainer_spec.byte_fallback = True
    model.trainer_spec.vocab_size = 266
    model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.escape_whitespaces = True
    model.normalizer_spec.remove_extra_whitespaces = False
    for piece, score, kind in [("<unk>", 0, sp.UNKNOWN), ("<s>", 0, sp.CONTROL), ("</s>", 0, sp.CONTROL)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    for i in range(256):
        model.pieces.add(piece=f"<0x{i:02X}>", score=0, type=sp.BYTE)
    for piece, score in [("▁", -3.0), ("a", -3.5), ("b", -3.7), ("ab", -4.0), ("▁ab", -5.0), ("▁a", -4.5), ("ba", -4.2)]:
        model.pieces.add(piece=piece, score=score, type=sp.NORMAL)
    path = tmp_path / "u.model"
    path.write_bytes(model.SerializeToString())
    tool = sp.Codec(str(path))
    for t in ["ab", "abab ba", "  aab", "abc é", "bbaabab ab"]:
        flat, _ = tool.encode([t])
        assert flat.tolist() == tool.oracle.encode(t), t
