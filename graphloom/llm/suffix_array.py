"""Suffix arrays by induced sorting, and their permuted common prefixes, in numpy.

Suffixes are classified as S (less than the next suffix) or L. The leftmost S suffixes of each S run cut the text into substrings;
these are sorted by inducing, named, and the text of names is sorted recursively unless all names differ. The order of all
suffixes is then induced from theirs in two linear scans, L suffixes upwards and S suffixes downwards.

A scan goes by ranges of buckets instead of single suffixes: a range whose suffixes induce nothing into the range itself is one
array operation; else it is halved, and a single bucket is scanned in waves, one per step of a run of equal symbols.
"""


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from graphloom.llm import passages

SMALL = 48  # below this a text is sorted by comparing
COMPARED = 1 << 17  # places compared at a time
BASE = 1 << 19  # below this a text of names is sorted by doubling prefixes, which ends the recursion


def classify(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; an end smaller than every symbol is understood, so the last one is L."""
    n = len(t)
    up = np.zeros(n, bool)
    if n > 1:
        differ = np.flatnonzero(t[1:] != t[:-1])
        rises = t[differ] < t[differ + 1]
        # a run of equal symbols takes the type of its last one
        lengths = np.diff(np.concatenate([[-1], differ]))
        up[: differ[-1] + 1 if len(differ) else 0] = np.repeat(rises, lengths)
    return up


def _ranges(sizes: np.ndarray, n: int) -> np.ndarray:
    """Starts of bucket ranges, of about the square root of the text each."""
    if len(sizes) <= 512:
        return np.arange(len(sizes))
    share = max(64, int(n**0.5))
    part = (np.cumsum(sizes) - sizes) // share
    return np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))


class _Scan:
    """The buckets of a text: at ``start[c]`` the L suffixes with first symbol ``c``, behind them the S suffixes."""

    def __init__(self, t: np.ndarray, up: np.ndarray, symbols: int):
        self.t, self.up, self.symbols = t, up, symbols
        self.code = t.astype(np.int16 if symbols <= 16384 else np.int32) * 2 + up
        self.kind = np.int32 if len(t) < 2**31 - 1 else np.int64
        counts = np.bincount(self.code, minlength=2 * symbols)
        self.sizes = counts[0::2] + counts[1::2]
        self.low, self.high = counts[0::2].astype(np.int64), counts[1::2].astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def _place(self, out: np.ndarray, head: np.ndarray, items: np.ndarray, codes: np.ndarray, down: bool) -> None:
        """Put items behind (or, scanning downwards, in front of) what their buckets already hold, in the given order."""
        if not len(items):
            return
        c = codes >> 1
        order = np.argsort(c.astype(np.uint8) if self.symbols <= 256 else c.astype(np.uint16) if self.symbols <= 65536 else c, kind="stable")
        c, items = c[order], items[order]
        at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        n = np.diff(np.concatenate([at, [len(c)]]))
        rank = np.arange(len(c)) - np.repeat(at, n)
        out[np.repeat(head[c[at]], n) - rank if down else np.repeat(head[c[at]], n) + rank] = items
        head[c[at]] += -n if down else n

    def upward(self, lms: np.ndarray) -> np.ndarray:
        """L suffixes in order, given the leftmost S suffixes in the order ``lms`` (by first symbol at least). All in one array of
        buckets; S places other than those of ``lms`` are not there."""
        t, n = self.t, len(self.t)
        many = np.bincount(t[lms], minlength=self.symbols).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(self.low + many)]).astype(np.int64)
        out = np.full(start[-1], -1, self.kind)
        tail = start[:-1] + self.low
        out[np.arange(len(lms)) + np.repeat(tail - (np.cumsum(many) - many), many)] = lms
        head = start[:-1].copy()
        last = n - 1
        out[head[t[last]]] = last
        head[t[last]] += 1

        def induce(items: np.ndarray, above: int) -> None:
            before = items[items > 0] - 1
            codes = self.code[before]
            ok = ((codes & 1) == 0) & (codes > 2 * above + 1) & (codes >= 2 * t[before + 1])
            self._place(out, head, before[ok], codes[ok], False)

        def scan(a: int, b: int) -> None:
            lo, hi = start[a], start[b]
            if lo == hi:
                return
            part = out[lo:hi]
            if b - a > 1:
                # before anything is induced: would a suffix of the range induce into it?
                if (part >= 0).all():
                    induce(part, b - 1)
                    return
                mid = (a + b) // 2
                scan(a, mid)
                scan(mid, b)
                return
            done = lo  # waves within one bucket
            full = lo + self.low[a]
            while done < head[a] < full:
                part = out[done : head[a]]
                done = head[a]
                before = part[part > 0] - 1
                before = before[self.code[before] == 2 * a]
                out[done : done + len(before)] = before
                head[a] += len(before)
            induce(out[lo:hi], a)

        cuts = _ranges(self.low + many, n)
        for a, b in zip(cuts, [*cuts[1:], self.symbols], strict=True):
            scan(int(a), int(b))
        return out, start

    def downward(self, upper: np.ndarray, upper_start: np.ndarray) -> np.ndarray:
        """The whole order, from the L suffixes that ``upward`` has placed."""
        t = self.t
        out = np.full(len(t), -1, self.kind)
        n = self.low
        lead = np.cumsum(n) - n
        spread = np.arange(n.sum())
        out[spread + np.repeat(self.start[:-1] - lead, n)] = upper[spread + np.repeat(upper_start[:-1] - lead, n)]
        head = self.start[1:] - 1

        def induce(items: np.ndarray, below: int) -> None:
            items = items[::-1]
            before = items[items > 0] - 1
            codes = self.code[before]
            ok = ((codes & 1) == 1) & (codes < 2 * below)
            self._place(out, head, before[ok], codes[ok], True)

        def scan(a: int, b: int) -> None:
            lo, hi = self.start[a], self.start[b]
            if lo == hi:
                return
            if b - a > 1:
                if (out[lo:hi] >= 0).all():
                    induce(out[lo:hi], a)
                    return
                mid = (a + b) // 2
                scan(mid, b)
                scan(a, mid)
                return
            floor, done = lo + self.low[a], hi
            # S suffixes of this bucket that larger buckets have induced, then waves among themselves
            while head[a] + 1 < done and head[a] >= floor:
                part = out[head[a] + 1 : done][::-1]
                done = head[a] + 1
                before = part[part > 0] - 1
                before = before[self.code[before] == 2 * a + 1]
                out[done - len(before) : done] = before[::-1]
                head[a] -= len(before)
            induce(out[lo:hi], a)

        cuts = _ranges(self.sizes, len(t))
        for a, b in reversed(list(zip(cuts, [*cuts[1:], self.symbols], strict=True))):
            scan(int(a), int(b))
        return out


def _names(t: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the substrings between leftmost S suffixes, in the order of ``order``: equal names for equal substrings."""
    place = np.empty(len(t) + 1, np.int64)
    place[lms] = np.arange(len(lms))
    ends = np.concatenate([lms[1:], [len(t) - 1]])
    length = ends[place[order]] - order + 1
    last = place[order] == len(lms) - 1  # runs into the end of the text: like no other
    a, b = order[:-1], order[1:]
    differs = (length[:-1] != length[1:]) | last[:-1] | last[1:]
    live = np.flatnonzero(~differs)
    step = 0
    while len(live):
        differs[live[t[a[live] + step] != t[b[live] + step]]] = True
        step += 1
        live = live[~differs[live] & (length[live] > step)]
    return np.concatenate([[0], np.cumsum(differs)])


def _by_doubling(t: np.ndarray) -> np.ndarray:
    """The order of suffixes by ranks of prefixes of twice the length in each round."""
    n, width = len(t), 1
    rank = t.astype(np.int64)
    while True:
        key = (rank + 1) * (n + 2)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2


def suffix_array(t: np.ndarray, symbols: int, names: bool = False) -> np.ndarray:
    """Starts of the suffixes of ``t`` (integers in ``[0, symbols)``) in their order."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    if n < SMALL:
        x = t.tolist()
        return np.array(sorted(range(n), key=lambda i: x[i:]), np.int64)
    if names and n < BASE:
        return _by_doubling(t)
    up = classify(t)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    scan = _Scan(t, up, symbols)
    if len(lms) > 1:
        first = lms[np.argsort(t[lms], kind="stable")]
        rough = scan.downward(*scan.upward(first))
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = rough[is_lms[rough]]
        named = _names(t, order, lms)
        if named[-1] + 1 < len(lms):
            reduced = np.empty(n, np.int32 if n < 2**31 else np.int64)
            reduced[order] = named
            order = lms[suffix_array(reduced[lms], int(named[-1]) + 1, True)]
    else:
        order = lms
    return scan.downward(*scan.upward(order))


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Of each place, the symbols that its suffix shares with the one before it in the order.

    Only irreducible values are compared, those whose preceding symbols differ; as value plus place never falls along the text,
    a running maximum gives the others. Symbols are compared eight bytes at a time.
    """
    n = len(t)
    kind = np.int32 if n < 2**30 else np.int64
    before = np.empty(n, kind)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n, dtype=kind)
    own = (before < 0) | (before == 0) | (at == 0)
    inner = np.flatnonzero(~own)
    own[inner] = t[inner - 1] != t[before[inner] - 1]
    irreducible = np.flatnonzero(own & (before >= 0))
    size = t.itemsize
    per = 8 // size
    raw = t.tobytes() + b"\0" * 16
    words = np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,))
    sums = np.full(n, -1, kind)  # value plus place
    for lo in range(0, len(irreducible), COMPARED):
        some = irreducible[lo : lo + COMPARED]
        value = np.zeros(len(some), np.int64)
        a, b, live = some, before[some].astype(np.int64), np.arange(len(some))
        while len(live):
            differ = words[a * size] ^ words[b * size]
            low = differ & (~differ + np.uint64(1))
            bits = np.where(differ == 0, 64, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64))
            value[live] += np.minimum(bits // (8 * size), n - np.maximum(a, b))
            on = (differ == 0) & (np.maximum(a, b) + per < n)
            a, b, live = a[on] + per, b[on] + per, live[on]
        sums[some] = value + some
    np.maximum.accumulate(sums, out=sums)
    sums -= at
    np.maximum(sums, 0, out=sums)
    sums[before < 0] = 0
    return sums


def first_places(parts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the parts, the least document among the parts that hold its string, from a suffix array of all parts.

    Parts are joined by a byte that UTF-8 never has (or, should a part hold it, by a symbol beyond all bytes). In the order of
    suffixes, windows with equal strings stand between the same common prefixes of at least ``length``.
    """
    joined = b"\xff".join([*parts, b""])
    t, symbols = np.frombuffer(joined, np.uint8), 256
    sizes = np.array([len(p) for p in parts], np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    if joined.count(b"\xff") != len(parts):
        t, symbols = t.astype(np.uint16), 257
        t[np.cumsum(sizes + 1) - 1] = 256
    sa = suffix_array(t, symbols)
    common = permuted_common_prefixes(t, sa)[sa]
    common[0] = 0
    groups = np.flatnonzero(common < length)
    del common
    # starts of windows are the first places of each part
    whole = np.repeat(np.tile([True, False], len(parts)), np.stack([windows, sizes + 1 - windows], 1).ravel())
    place_doc = np.full(len(t), passages.NEVER)
    place_doc[whole] = np.repeat(doc, windows)
    least = np.minimum.reduceat(place_doc[sa], groups)
    place_doc[sa] = np.repeat(least, np.diff(np.concatenate([groups, [len(t)]])))
    return windows, place_doc[whole], np.zeros(int(windows.sum()), np.int64)


def _cut(joined: bytes, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    return [joined[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def _no_starts(texts: list[bytes]) -> np.ndarray:
    return np.zeros(0, np.int64)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50, keep_text: str | None = None) -> DataFrame:
    """Remove each byte covered by a string of ``min_bytes`` bytes that also starts in a document with a smaller id.

    All columns but the text stay, and ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_sha256`` are added
    (replacing columns so named). With ``keep_text`` the remaining text is returned under that name; bytes of a character
    that was cut are left out of it. A null text counts as empty (and stays null), a row with a null id keeps everything, and rows
    with one id do not remove from each other.
    """
    import hashlib

    import pyarrow as pa

    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*[c for c in new if c not in (id_col, text_col)])
    passed = [f for f in docs.schema.fields if f.name != text_col and f.name != keep_text]
    fields = [*passed, *(T.StructField(c, T.LongType()) for c in new[:3]), T.StructField("kept_sha256", T.StringType())]
    if keep_text:
        fields.append(T.StructField(keep_text, T.StringType()))
    names, all_names = [f.name for f in passed], [f.name for f in fields]

    def finish(batch: pa.RecordBatch, texts: list[bytes], counts: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(counts)
        removed, spans, sha, kept = [], [], [], []
        for text, valid, a, b in zip(texts, batch.column(text_col).is_valid().to_pylist(), ends - counts, ends, strict=True):
            mask = gone[a:b]
            n = int(mask.sum())
            rest = text if not n else np.frombuffer(text, np.uint8)[~mask].tobytes()
            removed.append(n)
            spans.append(int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if n else 0)
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append((rest.decode("utf-8", "ignore") if valid else None) if keep_text else None)
        columns = [*(batch.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())] if keep_text else columns, all_names)

    kind = passages.Kind(min_bytes, max(1, min(20, min_bytes // 2)), False, passages.byte_units, _cut, _no_starts, first_places)
    return passages.remove_repeats(docs, kind, finish, T.StructType(fields), id_col, text_col, "suffix")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
