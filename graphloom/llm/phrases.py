"""Substring dedup by repeated-phrase automata.

Windows of ``length`` consecutive words are routed to shards (see :mod:`graphloom.llm.passages`), together with all text that can
hold them. In a shard, windows that recur are confirmed by a count of their hashes, compiled into Aho-Corasick automata over
word numbers, and all of the shard's text is streamed through them to locate every occurrence; the automaton compares words, so a
hash decides nothing but what is compiled.

The routed text is all text that can match. A pattern is a window, so each of its occurrences is a window with the same words; its anchor
depends on these words alone, so the occurrence lies in a segment with that anchor, and all segments of an anchor go to one shard.
What is not routed are segments whose anchor no other segment has, in any document: no window of theirs occurs twice. Streaming
them would find nothing; ``tests/llm/test_passages.py`` holds this against windows counted one by one.
"""

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from graphloom.llm import passages

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
POWERS = np.cumprod(np.full(1 << 12, passages.MULT, np.uint64))
PATTERNS = 60_000  # in one automaton
STREAM = 1 << 16  # words streamed at a time


def word_starts(texts: list[bytes]) -> np.ndarray:
    """Byte offset of each word in the joined texts (words never cross texts), and the end."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    word = ~SPACE[joined]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = np.cumsum([len(t) for t in texts])[:-1] if texts else np.zeros(0, np.int64)
    edges = edges[edges < len(word)]
    first[edges] = word[edges]
    return np.concatenate([np.flatnonzero(first), [len(joined)]])


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the words of each text."""
    starts = word_starts(texts)
    ends = np.cumsum([len(t) for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts[:-1], ends)]))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    hashes = np.zeros(len(starts) - 1, np.uint64)
    step = 1 << 15
    with np.errstate(over="ignore"):
        for lo in range(0, len(hashes), step):
            own = starts[lo : lo + step + 1]
            part = joined[own[0] : own[-1]]
            inside = np.arange(len(part)) - np.repeat(own[:-1] - own[0], np.diff(own))
            powers = POWERS[inside] if inside.max() < len(POWERS) else np.power(passages.MULT, inside.astype(np.uint64) + np.uint64(1))
            terms = np.where(SPACE[part], np.uint64(0), passages.BYTE_HASH[part] * powers)
            hashes[lo : lo + step] = np.add.reduceat(terms, own[:-1] - own[0])
        return passages.mix(hashes), counts.astype(np.int64)


def _cut(joined: bytes, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    """Words from ``lo`` to ``hi`` joined by one space."""
    out = []
    for a, b in zip(starts[lo].tolist(), starts[hi].tolist(), strict=True):
        out.append(b" ".join(joined[a:b].split()))
    return out


def first_places(parts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the parts, the least (document, start) at which its words occur."""
    number: dict[bytes, int] = {}
    words = [np.array([number.setdefault(w, len(number) + 1) for w in p.split(b" ")], np.int64) for p in parts]
    counts = np.array([len(w) for w in words], np.int64)
    windows = np.maximum(counts - length + 1, 0)
    flat = np.concatenate(words) if words else np.zeros(0, np.int64)
    base = np.cumsum(counts) - counts
    part = np.repeat(np.arange(len(parts)), windows)
    inside = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[part] + inside
    first_doc, first_start = doc[part].copy(), start[part] + inside
    if not len(at):
        return windows, first_doc, first_start
    with np.errstate(over="ignore"):
        h = passages._grams(passages.mix(flat.astype(np.uint64)), length)[at]
    order = np.argsort(h, kind="stable")
    edge = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    groups = np.flatnonzero(edge)
    many = np.diff(np.concatenate([groups, [len(h)]])) > 1
    chosen = order[groups[many]]  # one window for each hash that recurs
    window_at = np.full(len(flat) + 1, -1, np.int64)
    window_at[at] = np.arange(len(at))
    numbers = flat.tolist()
    ends = np.concatenate([np.flatnonzero(np.diff(np.arange(len(flat)) // STREAM)) + 1, [len(flat)]]) if len(flat) else []
    cuts = np.unique(base[np.searchsorted(base, ends, side="left").clip(max=len(base) - 1)].tolist() + [0, len(flat)])
    for lo in range(0, len(chosen), PATTERNS):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, a in enumerate(at[chosen[lo : lo + PATTERNS]].tolist()):
            automaton.add_word(tuple(numbers[a : a + length]), i)
        automaton.make_automaton()
        ends_, which = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for e, i in automaton.iter(tuple(numbers[a:b])):
                ends_.append(a + e)
                which.append(i)
        w = window_at[np.array(ends_, np.int64) - length + 1]
        which = np.array(which, np.int64)[w >= 0]  # matches across two parts are no windows
        w = w[w >= 0]
        order = np.lexsort((first_start[w], first_doc[w], which))
        which, w = which[order], w[order]
        heads = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(w) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([heads, [len(w)]]))
        d, s = np.repeat(first_doc[w[heads]], n), np.repeat(first_start[w[heads]], n)
        first_doc[w], first_start[w] = d, s
    return windows, first_doc, first_start


def remove_repeated_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, keep_text: str | None = None) -> DataFrame:
    """Remove each word covered by ``length`` consecutive words that also start earlier: in a document with a smaller id, or in the
    same one at an earlier word.

    Words are runs of other characters than space and U+0009 to U+000D. All columns but the text stay; ``n_words``, ``n_removed``
    and ``kept_sha256`` (of the remaining words joined by one space) are added, replacing columns so named, and with ``keep_text``
    those words. A null text has no words (and stays null); a row with a null id keeps everything; of rows with one id, equal starts
    are not earlier than one another.
    """
    new = ["n_words", "n_removed", "kept_sha256"]
    docs = docs.drop(*[c for c in new if c not in (id_col, text_col)])
    passed = [f for f in docs.schema.fields if f.name != text_col and f.name != keep_text]
    fields = [*passed, *(T.StructField(c, T.LongType()) for c in new[:2]), T.StructField(new[2], T.StringType())]
    if keep_text:
        fields.append(T.StructField(keep_text, T.StringType()))
    names, all_names = [f.name for f in passed], [f.name for f in fields]

    def finish(batch: pa.RecordBatch, texts: list[bytes], counts: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(counts)
        removed, sha, kept = [], [], []
        for text, valid, a, b in zip(texts, batch.column(text_col).is_valid().to_pylist(), ends - counts, ends, strict=True):
            mask = gone[a:b]
            words = text.split()
            n = int(mask.sum())
            rest = b" ".join(compress(words, (~mask).tolist()) if n else words)
            removed.append(n)
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append((rest.decode() if valid else None) if keep_text else None)
        columns = [*(batch.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())] if keep_text else columns, all_names)

    kind = passages.Kind(length, max(1, min(6, length // 2)), True, word_units, _cut, word_starts, first_places)
    return passages.remove_repeats(docs, kind, finish, T.StructType(fields), id_col, text_col, "phrases")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_phrases(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
