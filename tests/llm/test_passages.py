import numpy as np
import pytest

from graphloom.llm import passages


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13, 20])
def test_grams_depend_on_content_only(k):
    rng = np.random.default_rng(k)
    x = rng.integers(0, 4, 300).astype(np.uint64)
    g = passages._grams(passages.mix(x + np.uint64(1)), k)
    assert len(g) == len(x) - k + 1
    seen = {}
    for i, v in enumerate(g.tolist()):
        assert seen.setdefault(v, x[i : i + k].tolist()) == x[i : i + k].tolist()
    assert len(seen) == len({tuple(x[i : i + k].tolist()) for i in range(len(g))})


@pytest.mark.parametrize("chunk", [7, 1 << 15])
def test_segments_cover_every_window_once_and_equal_windows_meet(monkeypatch, chunk):
    monkeypatch.setattr(passages, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    length, k = 12, 5
    shared = rng.integers(0, 9, 40)
    docs = [np.concatenate([rng.integers(0, 9, rng.integers(0, 30)), shared[a:], rng.integers(0, 9, rng.integers(0, 30))]) for a in (0, 3, 9)] + [rng.integers(0, 9, n) for n in (0, 3, 11, 12, 13)]
    counts = np.array([len(d) for d in docs])
    flat = np.concatenate(docs).astype(np.uint64)
    first, last, anchor = passages.segments(passages.mix(flat + np.uint64(1)), counts, length, k)
    owner = {}
    for a, b, h in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True):
        assert b - a <= length - k + 1
        for w in range(a, b):
            assert w not in owner
            owner[w] = h
    starts = np.cumsum(counts) - counts
    windows = {int(s + i): tuple(d[i : i + length].tolist()) for s, d in zip(starts, docs, strict=True) for i in range(len(d) - length + 1)}
    assert set(owner) == set(windows)
    by_text = {}
    for w, text in windows.items():
        assert by_text.setdefault(text, owner[w]) == owner[w]


def test_sent_values_come_back():
    x = np.array([0, 1, 2**31, 2**40 - 1], np.uint64)
    assert passages._receive(passages._send(x, 5), 5).tolist() == x.tolist()
    assert passages._open(passages._squeeze(b"")) == b""
