"""Counts of the transducer against the reference library."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import transducer as tr

pytestmark = pytest.mark.skipif(not os.path.exists(tr.DEFAULT_MODEL), reason="no tokenizer files")
TEXTS = ["", " ", "  two  spaces ", "a\tb\n\nc", "日本語 é \U0001f600\x00", "▁ real ▁▁ marks", "</s> <unk> <0x41>", "x" * 5000, "word " * 20_000, "aaaaab" * 999, " " * 3001, "日本語" * 1000, "é"]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tr.DEFAULT_MODEL)


def counted(tool, texts):
    column = pa.array(texts, pa.large_string())
    _, offsets, data = column.buffers()
    return tool.counts(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64)[: len(texts) + 1]).tolist()


def check(library, texts):
    assert counted(tr.transducer(tr.DEFAULT_MODEL), texts) == [len(library.encode(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(max_size=80), max_size=6))
def test_any_text(library, texts):
    check(library, texts)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet="abinest ▁.é日", max_size=120), max_size=6))
def test_words_of_few_letters(library, texts):
    check(library, texts)


@pytest.mark.parametrize(("chunk", "segment", "warm"), [(256, 4 << 20, 24), (7, 4 << 20, 0), (16, 101, 3), (5, 13, 24)])
def test_cuts_change_nothing(library, monkeypatch, chunk, segment, warm):
    """Chunks and segments cut anywhere, guesses good and bad: the maps still join to the whole."""
    for name, value in (("CHUNK", chunk), ("SEGMENT", segment), ("WARM", warm)):
        monkeypatch.setattr(tr, name, value)
    r = random.Random(3)
    more = ["".join(r.choice(letters) for _ in range(r.randint(0, 700))) for letters in ("the", "abcdefgh  etnio.,\n", "ab日é ", "aaaaaaab") for _ in range(6)]
    check(library, [t[:3000] for t in TEXTS] + more)


def test_states_are_forgotten_and_made_again(library, monkeypatch):
    monkeypatch.setattr(tr, "MAX_STATES", 50)
    monkeypatch.setattr(tr, "SEGMENT", 300)
    tool = tr.Transducer(tr.DEFAULT_MODEL)
    texts = [t[:4000] for t in TEXTS] + ["international counts of very long unbroken words" * 40]
    assert counted(tool, texts) == [len(library.encode(t)) for t in texts]
    assert len(tool.states) < 3000


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(tr.DEFAULT_MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    (tmp_path / "u.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merges"):
        tr.Transducer(str(tmp_path / "u.model"))


def test_query(spark, library, tmp_path):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(98, "a " * 3_000_000, "x"), (99, None, "x"), (0, "", "x"), (97, "tokens " * 4095, "x"), (96, "tokens " * 4094, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = tr.op12_token_counts(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in rows)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in found.collect()) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in found.collect()) and {r.doc_id for r in found.where("over_limit").collect()} >= {98, 8}
    kept = tr.count_tokens(docs)
    assert kept.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"] and kept.count() == len(rows)
    assert tr.count_tokens(docs.limit(0)).count() == 0
