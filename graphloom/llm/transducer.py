"""Token counts by a tokenizer compiled to a finite-state transducer.

Of greedy pair merging two things are true that make it finite-state. The tokens of a prefix are settled by what its last token is: they
are the tokens of the prefix before that token, and then the token. And a sequence of tokens is the encoding of its text just when each
neighbouring two are that of theirs. So a state needs, for every end of the text read that may still grow into a piece, which token
comes before it and how many tokens fewer there are up to it; reading a character gives exactly one next state, and the change of
the number of tokens of the prefix is what the transition emits.

States are made when a text first needs them, and transitions kept in one open-addressing table, so that a batch is run by numpy over
many chunks in step. Chunks begin where two characters meet that no piece has side by side: there the next state is the same whatever came
before, and the chunk's state map is constant. Where no such place is near (a long run of letters), a chunk begins anyway: its map is
made for the state that the characters before it suggest, and for every state that the chunk before it is found to end in. Maps are put
together by doubling, a parallel prefix scan over the chunks of each text.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import small_batches, trimmed_batches
from graphloom.llm.sentencepiece_backend import BPE, BYTE, CONTROL, DEFAULT_MODEL, METASPACE, NORMAL, UNKNOWN, local_path

LIMIT = 4096
CHUNK = 256  # characters of a chunk, about
WARM = 24  # characters before a chunk that suggest its first state
SEGMENT = 4 << 20  # bytes that are run at a time
MAX_STATES = 150_000  # states that are kept; beyond, they are made anew
START = 0
MIX = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """The transducer of a SentencePiece model with merges, byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only models of merges with byte fallback, without user-defined or unused pieces, are compiled")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser is compiled")
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        alphabet = sorted(w for w in self.score if len(w) == 1)
        if {c for w in self.score for c in w} - set(alphabet):
            raise ValueError("a piece has a character that is no piece")
        # symbols 0 to 3: characters without a piece, of one to four bytes
        self.chars = ["", "", "", "", *alphabet]
        self.width = len(self.chars)
        code = np.arange(0x110000)
        self.symbol = ((code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000)).astype(np.int32)
        for i, c in enumerate(self.chars[4:], 4):
            self.symbol[ord(c)] = i
        if METASPACE in self.score:
            self.symbol[ord(" ")] = self.symbol[ord(METASPACE)]
        self.open = {w[:k] for w in self.score for k in range(len(w))}  # what may grow into a piece
        place = {c: i for i, c in enumerate(self.chars)}
        beside = {(w[k], w[k + 1]) for w in self.score for k in range(len(w) - 1)}
        self.beside = beside
        self.joined = np.zeros(self.width * self.width, bool)
        for a, b in beside:
            self.joined[place[a] * self.width + place[b]] = True
        self.fits: dict[tuple[str, str], bool] = {}
        self.prefixed = norm.add_dummy_prefix
        self.forget()

    # the machine

    def forget(self) -> None:
        """Begin with the first state only."""
        self.states: list[tuple] = [("", ((0, "", 0),))]
        self.number = {self.states[0]: START}
        self.used, self.bits = 0, 16
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        self.entry, self.base = self.step(START, int(self.symbol[ord(METASPACE)])) if self.prefixed else (START, 0)

    def encoded(self, text: str) -> list[str]:
        """The merges done by hand: the best of the neighbouring two, the leftmost of equals, until none is a piece."""
        out = list(text)
        while len(out) > 1:
            best = max(range(len(out) - 1), key=lambda k: (self.score.get(out[k] + out[k + 1], -np.inf), -k))
            if out[best] + out[best + 1] not in self.score:
                break
            out[best : best + 2] = [out[best] + out[best + 1]]
        return out

    def fit(self, before: str, piece: str) -> bool:
        """Whether the encoding of the two is the two."""
        key = (before, piece)
        if key not in self.fits:
            self.fits[key] = self.encoded(before + piece) == [x for x in key if x]
        return self.fits[key]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state, and by how much the number of tokens changes. A state is the longest end of the text that may grow into a piece,
        and for every such end its length, the token before it ("" where none can matter) and the change of tokens since."""
        if symbol < 4:
            return START, symbol + 1
        tail, ends = self.states[state]
        c = self.chars[symbol]
        grown = tail + c
        at = {n: (before, since) for n, before, since in ends}
        piece, change = next((grown[k:], at[len(grown) - k - 1][1] + 1) for k in range(len(grown)) if grown[k:] in self.score and self.fit(at[len(grown) - k - 1][0], grown[k:]))
        tail = next(grown[k:] for k in range(len(grown) + 1) if grown[k:] in self.open)
        new = [(0, piece, 0)]
        for n in range(1, len(tail) + 1):
            if tail[len(tail) - n :] in self.open:
                before, since = at[n - 1]
                new.append((n, before if before and (before[-1], tail[len(tail) - n]) in self.beside else "", since - change))
        key = (tail, tuple(new))
        number = self.number.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        return number, change

    # its table

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if (self.used + len(keys)) * 5 > len(self.keys) * 2:
            old = self.keys >= 0
            kept, held = self.keys[old], self.values[old]
            while (self.used + len(keys)) * 5 > (1 << self.bits) * 2:
                self.bits += 1
            self.keys, self.values, self.used = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), 0
            self._put(kept, held)
        mask, at, left = len(self.keys) - 1, self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]  # the last of those that want one slot has it
            done = self.keys[at[left]] == keys[left]
            self.values[at[left[done]]] = values[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & mask
        self.used += len(keys)

    def _get(self, keys: np.ndarray) -> np.ndarray:
        """The transitions of ``state * width + symbol``: next state and change, packed. Unknown ones are made."""
        at = self._slots(keys)
        met = self.keys[at]
        if (met == keys).all():
            return self.values[at]
        mask, left = len(self.keys) - 1, np.flatnonzero(met != keys)
        lost = []
        while len(left):
            empty = self.keys[at[left]] < 0
            lost.append(left[empty])
            left = left[~empty]
            at[left] = (at[left] + 1) & mask
            left = left[self.keys[at[left]] != keys[left]]
        lost = np.concatenate(lost)
        if not len(lost):
            return self.values[at]
        fresh = np.unique(keys[lost])
        made = [self.step(*divmod(k, self.width)) for k in fresh.tolist()]
        self._put(fresh, np.array([(to << 8) | (change + 128) for to, change in made], np.int64))
        return self._get(keys)

    def run(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last states and changes of chunks, all in step."""
        order = np.argsort(-length, kind="stable")
        start, length, state = start[order], length[order], state[order].astype(np.int64)
        change = np.zeros(len(start), np.int64)
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(steps), "left")  # chunks longer than each step
        for i, n in enumerate(active.tolist()):
            v = self._get(state[:n] * self.width + symbols[start[:n] + i])
            state[:n] = v >> 8
            change[:n] += (v & 255) - 128
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], change[back]

    # texts

    def _chunks(self, symbols: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks start, and which of them start at a guess; ``firsts`` are the starts of texts."""
        apart = np.flatnonzero(~self.joined[symbols[:-1].astype(np.int64) * self.width + symbols[1:]]) + 1
        grid = np.arange(CHUNK, len(symbols), CHUNK)
        found = np.searchsorted(apart, grid)
        near = np.append(apart, len(symbols) + CHUNK)[found]
        exact = near < grid + CHUNK
        starts = np.unique(np.concatenate([firsts, np.where(exact, near, grid)]))
        known = np.zeros(len(symbols) + 1, bool)
        known[firsts] = True
        known[near[exact]] = True
        starts = starts[starts < len(symbols)]
        return starts, ~known[starts]

    def segment(self, symbols: np.ndarray, firsts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The change of tokens over each text of a segment, and the state at its end. ``entries``: the state each text begins in."""
        starts, guessed = self._chunks(symbols, firsts)
        length = np.diff(np.append(starts, len(symbols)))
        text = np.searchsorted(firsts, starts, "right") - 1
        first = np.concatenate([[True], text[1:] != text[:-1]])
        entry = np.where(first, entries[text], START)
        if guessed.any():
            some = np.flatnonzero(guessed)
            back = np.minimum(WARM, starts[some] - firsts[text[some]])
            entry[some] = self.run(symbols, starts[some] - back, back, np.full(len(some), START))[0]
        # rows of maps: chunk, state at its start, state at its end, change
        chunk, rows = np.arange(len(starts)), [np.arange(len(starts)), entry]
        to, change = self.run(symbols, starts, length, entry)
        follows = np.append(~first[1:], False)  # the next chunk is of the same text
        while True:
            asks = follows[chunk] & np.append(guessed[1:], False)[chunk]
            want = np.unique((chunk[asks] + 1) * (1 << 32) + to[asks])
            fresh = np.setdiff1d(want, rows[0] * (1 << 32) + rows[1])
            if not len(fresh):
                break
            more = fresh >> 32
            ends, add = self.run(symbols, starts[more], length[more], fresh & ((1 << 32) - 1))
            rows = [np.concatenate([rows[0], more]), np.concatenate([rows[1], fresh & ((1 << 32) - 1)])]
            chunk, to, change = rows[0], np.concatenate([to, ends]), np.concatenate([change, add])
        # each row's next: the row of the next chunk that begins where this one ends; the only one where the map is constant
        n = len(chunk)
        name = chunk * (1 << 32) + rows[1]
        order = np.argsort(name)
        only = np.full(len(starts) + 1, n)
        only[chunk[: len(starts)]] = np.arange(len(starts))
        at = np.searchsorted(name[order], (chunk + 1) * (1 << 32) + to)
        exact = order[np.minimum(at, n - 1)]
        loose = np.append(~guessed[1:], True)[chunk]
        next_ = np.where(follows[chunk], np.where(loose, only[chunk + 1], exact), n)
        total, next_, tip = np.append(change, 0), np.append(next_, n), np.append(np.arange(n), n)
        while (next_ < n).any():
            total, tip, next_ = total + total[next_], np.where(next_ < n, tip[next_], tip), next_[next_]
        heads = np.flatnonzero(first)
        return total[heads], np.append(to, START)[tip[heads]]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text of an Arrow string column: its bytes and offsets. A text longer than a segment goes on in the next one,
        from the state it is in."""
        out = np.where(np.diff(offsets) > 0, self.base, 0)
        lo, end, state, inside = int(offsets[0]), int(offsets[-1]), START, False
        held = np.flatnonzero(np.diff(offsets) > 0)
        begin = offsets[:-1][held]
        while lo < end:
            hi = min(lo + SEGMENT, end)
            while hi < end and data[hi] & 0xC0 == 0x80:
                hi -= 1
            part = data[lo:hi]
            symbols = self.symbol[np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)]
            a, b = np.searchsorted(begin, [lo, hi])
            places = np.cumsum((part & 0xC0) != 0x80) - 1
            firsts, texts, entries = places[begin[a:b] - lo], held[a:b], np.full(b - a, self.entry)
            if inside:
                firsts, texts, entries = np.append(0, firsts), np.append(held[a - 1], texts), np.append(state, entries)
            total, last = self.segment(symbols, firsts, entries)
            out[texts] += total
            inside, state = hi < end and hi not in begin[b : b + 1], int(last[-1])
            lo = hi
            if len(self.states) > MAX_STATES:
                kept = self.states[state]
                self.forget()
                state = self.number.setdefault(kept, len(self.states))
                if state == len(self.states):
                    self.states.append(kept)
        return out


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, model_path: str = DEFAULT_MODEL, text_col: str = "text", limit: int = LIMIT, keep_text: bool = True, ship: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; columns so named are replaced, and with ``keep_text=False`` the text is left out.

    A null text counts as an empty one, with 0 in both. Repeated rows are counted one by one, nothing depends on the order of rows, and an
    empty table gives an empty one. A text of any length is run in segments. ``model_path`` is a path that every worker sees; with ``ship``
    the driver's file is sent to them.
    """
    small_batches(docs.sparkSession)
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    names = {f.name for f in new}
    kept = [f for f in docs.schema.fields if f.name not in names and (keep_text or f.name != text_col)]
    schema = T.StructType([*kept, *new])
    source = "__counted"
    if ship:
        docs.sparkSession.sparkContext.addFile(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = transducer(local_path(model_path, ship))
        for batch in batches:
            text = batch.column(source)
            text = text.cast(pa.large_string())
            _, offsets, data = text.buffers()
            offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
            n = tool.counts(data, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], [f.name for f in schema.fields])

    columns = [F.col(f.name) for f in kept]
    return docs.select(*columns, F.coalesce(F.col(text_col), F.lit("")).alias(source)).mapInArrow(trimmed_batches(run), schema)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
