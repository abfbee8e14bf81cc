"""Routing of repeated passages: the Spark side shared by suffix-array and substring dedup.

A text is a sequence of units (bytes, or words). A window is ``length`` consecutive units of one document; two windows match
when their units are equal. Of every window the ``anchor`` is its least ``k``-unit gram by a hash, leftmost on ties, so equal
windows have equal anchors. A segment is a maximal run of windows with the same anchor place: a few dozen windows at most,
whatever the text. The steps are

1. whole documents are packed into blocks of a few MB (one row each), written in the shared folder and bucketed by block, so
   that answers come to the documents and no step after moves them;
2. each block sends its distinct anchors, cut to a few bytes, to the anchor's shard, which answers with one bit per anchor:
   whether windows around it can match anything (another block has it, or the block itself holds it twice);
3. each block sends the distinct segments around such anchors with their first place in the block to the anchor's shard, and
   keeps a list of where they occur;
4. a shard now holds every window that can match any of its windows. It finds for each window the first place in the corpus,
   by the operator's own method, and answers each block with runs of equal first places;
5. each block removes what the answers say.

Nothing is sent per pair. A passage that many documents share is sent once per block, so a passage in a third of all rows
gives its shard one row part per block. The number of shards and the bytes kept of an anchor grow with the corpus.
"""

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import small_batches, trimmed, trimmed_batches, trimmed_pair
from graphloom.sources.tables import bucketed, written

BLOCK_BYTES = 2 << 20
SHARD_BYTES = 8 << 20  # of corpus text for each shard of anchors
FINE = 4  # shards of segments in each of these
CHUNK = 1 << 15  # units handled at a time, so that the arrays stay in cache
MULT = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
LEVEL = 3  # of zstd, for what is written
NEVER = np.iinfo(np.int64).max


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * MULT)


@dataclass(frozen=True)
class Kind:
    """What the two operators set: the units, and how a shard finds first places."""

    length: int
    k: int
    by_place: bool  # whether an earlier start in the same document counts as earlier
    units: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]  # texts -> unit hashes, units of each text
    cut: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], list[bytes]]  # all texts joined, unit starts, segment starts, segment ends -> contents
    starts: Callable[[list[bytes]], np.ndarray]  # byte offset of each unit in the joined texts, and the end
    match: Callable[[list[bytes], np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]  # segments, first doc, first start, length -> windows of each segment, first doc and first start of each window


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_HASH[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``k`` units, by doubling."""
    out, width, done, power, cur, step = None, 1, 0, MULT, h, MULT
    while True:
        if k & width:
            if out is None:
                out, done, power = cur, width, step
            else:  # out covers ``done`` units; put ``width`` units in front
                m = len(h) - done - width + 1
                out = cur[:m] * power + out[width : width + m]
                done, power = done + width, power * step
        width *= 2
        if width > k:
            return mix(out)
        half = width // 2
        cur = cur[: len(cur) - half] * step + cur[half:]
        step = step * step


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, cur = 1, x
    while span * 2 <= width:
        cur = np.minimum(cur[: len(cur) - span], cur[span:])
        span *= 2
    return np.minimum(cur[: len(x) - width + 1], cur[width - span :]) if span < width else cur


def segments(h: np.ndarray, counts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end of windows, and anchor hash of every segment, in places of the joined documents."""
    n = len(h)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.empty(n - length + 1, np.int64)
    anchor = np.empty(n - k + 1, np.uint64)
    high = np.uint64(0xFFFFFFFF00000000)
    with np.errstate(over="ignore"):
        for lo in range(0, n - length + 1, CHUNK):
            part = h[lo : lo + CHUNK + length - 1]
            g = _grams(part, k)
            anchor[lo : lo + len(g)] = g
            low = _sliding_min((g & high) | np.arange(len(g), dtype=np.uint64), length - k + 1)
            place[lo : lo + len(low)] = (low & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo
    ends = np.cumsum(counts)
    for s, e in zip(ends - counts, ends, strict=True):
        place[max(s, e - length + 1) : e] = -1  # windows that would leave their document
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]])
    ok = place[first] >= 0
    first, last = first[ok], last[ok]
    with np.errstate(over="ignore"):
        return first, last, mix(anchor[place[first]] + MULT)


def _pack(ids: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))
        seq, base = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.nan_to_num(np.array(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), float))
            cuts = np.unique([0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_BYTES)) + 1), len(sizes)]).astype(int)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(int(lo), int(hi - lo)))
                yield pa.RecordBatch.from_arrays([pa.array([base | seq], pa.int64()), pa.array([int(sizes[lo:hi].sum())], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "bytes", "docs"])
                seq += 1

    return run


def _unpack(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def _texts(docs: pa.RecordBatch, text: str) -> list[bytes]:
    return [x.as_py().encode() if x.is_valid else b"" for x in docs.column(text)]


def _doc_ids(docs: pa.RecordBatch, ids: str) -> np.ndarray:
    """Ids as int64; a null id is later than any other and has nothing before it, see ``take``."""
    return np.array([NEVER if x is None else x for x in docs.column(ids).to_pylist()], np.int64)


def _cut_hash(a: np.ndarray, shards: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return (a % np.uint64(shards)).astype(np.int64), (a // np.uint64(shards)) & np.uint64((1 << (8 * width)) - 1)


def _send(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _receive(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _block_anchors(kind: Kind, docs: pa.RecordBatch, ids: str, text: str, shards: int, width: int):
    """All segments of a block, and its distinct cut anchors in order of (shard, value) with whether the block has them twice."""
    texts = _texts(docs, text)
    h, counts = kind.units(texts)
    first, last, a = segments(h, counts, kind.length, kind.k)
    shard, value = _cut_hash(a, shards, width)
    order = np.lexsort((value, shard))
    s, v = shard[order], value[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (v[1:] != v[:-1])]) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    if kind.by_place:
        twice = np.diff(np.concatenate([at, [len(s)]])) > 1
    else:
        doc = np.repeat(_doc_ids(docs, ids), counts)[first[order]] if len(s) else np.zeros(0, np.int64)
        twice = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return texts, h, counts, first, last, s[at], v[at], twice, which


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(raw)


def _open(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


BLOCK_TYPE = "block long, bytes long, docs binary"
ANCHOR_TYPE = "shard int, block long, anchors binary, twice binary"
BIT_TYPE = "block long, shard int, bits binary"
SEGMENT_TYPE = "kind int, block long, shard int, content binary, lens binary, docs binary, starts binary"
NOTE_TYPE = "block long, kind int, shard int, a binary, b binary, c binary, d binary"


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def remove_repeats(docs: DataFrame, kind: Kind, finish: Callable, result: T.StructType, id_col: str, text_col: str, name: str) -> DataFrame:
    """``finish(docs batch, texts, unit counts, removed units)`` makes the result rows of a block. A row with a null id keeps all
    and makes no other row lose anything; rows with equal ids are not earlier than one another."""
    small_batches(docs.sparkSession)
    blocks = bucketed(docs.mapInArrow(trimmed_batches(_pack(id_col, text_col)), BLOCK_TYPE), f"{name}-blocks", "block")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    shards = max(8, math.ceil(total / SHARD_BYTES))
    # a cut anchor equals another one's for about one in 4,000 (there is one anchor for some 18 bytes); that costs a needless segment
    width = min(8, math.ceil((math.log2(total + 2) + 8 - math.log2(shards)) / 8))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(ANCHOR_TYPE)
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("docs"), strict=True):
                *_, s, v, twice, _ = _block_anchors(kind, _unpack(raw.as_py()), id_col, text_col, shards, width)
                if len(s):
                    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                    yield _batch(schema, [(int(s[lo]), block, _send(v[lo:hi], width), np.packbits(twice[lo:hi]).tobytes()) for lo, hi in zip(at, [*at[1:], len(s)], strict=True)])

    def bits(table: pa.Table) -> pa.Table:
        rows, schema = table.to_pylist(), _arrow(BIT_TYPE)
        values = [_receive(r["anchors"], width) for r in rows]
        twice = [np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(v)) for r, v in zip(rows, values, strict=True)]
        v = np.concatenate(values)
        order = np.argsort(v)
        new = np.concatenate([[True], v[order][1:] != v[order][:-1]])
        at = np.flatnonzero(new)
        hit = (np.diff(np.concatenate([at, [len(v)]])) > 1) | (np.maximum.reduceat(np.concatenate(twice)[order], at) > 0)
        out = np.empty(len(v), bool)
        out[order] = hit[np.cumsum(new) - 1]
        ends = np.cumsum([len(x) for x in values])
        return pa.Table.from_batches([_batch(schema, [(r["block"], r["shard"], np.packbits(out[e - len(x) : e]).tobytes()) for r, x, e in zip(rows, values, ends, strict=True)])])

    def sends(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = _arrow(SEGMENT_TYPE)
        out: list[tuple] = []
        if right.num_rows:
            for raw in left.column("docs"):
                docs_ = _unpack(raw.as_py())
                texts, h, counts, first, last, s, v, _, which = _block_anchors(kind, docs_, id_col, text_col, shards, width)
                per = dict(zip(*np.unique(s, return_counts=True), strict=True))
                got = {r["shard"]: r["bits"] for r in right.to_pylist()}
                hit = np.concatenate([np.unpackbits(np.frombuffer(got[x], np.uint8), count=n) for x, n in sorted(per.items())]).astype(bool)
                ids = _doc_ids(docs_, id_col)
                row = np.searchsorted(np.cumsum(counts), first, side="right")
                take = np.flatnonzero(hit[which] & (ids[row] != NEVER)) if len(first) else np.zeros(0, np.int64)
                if not len(take):
                    continue
                fine = s * FINE + (v % np.uint64(FINE)).astype(np.int64)
                take = take[np.argsort(fine[which[take]], kind="stable")]
                shard = fine[which[take]]
                offset = first[take] - (np.cumsum(counts) - counts)[row[take]]
                contents = kind.cut(b"".join(texts), kind.starts(texts), first[take], last[take] + kind.length - 1)
                index: dict[tuple[int, bytes], int] = {}
                seg = np.array([index.setdefault(x, len(index)) for x in zip(shard.tolist(), contents, strict=True)], np.int64)
                doc = ids[row[take]]
                order = np.lexsort((offset, doc, seg))
                head = order[np.searchsorted(seg[order], np.arange(len(index)))]
                keys = list(index)
                owner = np.array([x for x, _ in keys], np.int64)
                at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                b = key[0].as_py()
                for lo, hi in zip(at, [*at[1:], len(owner)], strict=True):
                    some = [x for _, x in keys[lo:hi]]
                    start = offset[head[lo:hi]] if kind.by_place else np.zeros(hi - lo, np.int64)
                    out.append((0, b, int(owner[lo]), _squeeze(b"".join(some)), np.array([len(x) for x in some], np.int32).tobytes(), doc[head[lo:hi]].tobytes(), start.astype(np.int64).tobytes()))
                out.append((1, b, -1, None, _squeeze(seg.astype(np.int32).tobytes()), _squeeze(row[take].astype(np.int32).tobytes()), _squeeze(first[take].astype(np.int32).tobytes())))
        return pa.Table.from_batches([_batch(schema, out)], schema=schema)

    def answers(table: pa.Table) -> pa.Table:
        schema = _arrow(NOTE_TYPE)
        rows = table.to_pylist()
        index: dict[bytes, int] = {}
        which, docs_, starts = [], [], []
        for r in rows:
            lens, body, at, mine = np.frombuffer(r["lens"], np.int32), _open(r["content"]), 0, []
            for n in lens.tolist():
                mine.append(index.setdefault(body[at : at + n], len(index)))
                at += n
            which.append(np.array(mine, np.int64))
            docs_.append(np.frombuffer(r["docs"], np.int64))
            starts.append(np.frombuffer(r["starts"], np.int64))
        seg, doc, start = np.concatenate(which), np.concatenate(docs_), np.concatenate(starts)
        order = np.lexsort((start, doc, seg))
        head = order[np.searchsorted(seg[order], np.arange(len(index)))]
        windows, d, s = kind.match(list(index), doc[head], start[head], kind.length)
        # runs of windows with the same first document at consecutive starts (op 2: the same document)
        ends = np.cumsum(windows)
        fresh = np.ones(len(d), bool)
        if len(d) > 1:
            fresh[1:] = (d[1:] != d[:-1]) | (s[1:] - s[:-1] != int(kind.by_place))
            fresh[(ends - windows)[windows > 0]] = True
        at = np.flatnonzero(fresh)
        run_len = np.diff(np.concatenate([at, [len(d)]])).astype(np.int32)
        run_doc, run_start = d[at], s[at]
        run_of = np.searchsorted(ends, at, side="right")
        runs = np.bincount(run_of, minlength=len(index)).astype(np.int64)
        base = np.cumsum(runs) - runs
        out = []
        for r, mine in zip(rows, which, strict=True):
            n = runs[mine]
            pick = np.repeat(base[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((r["block"], 2, r["shard"], _squeeze(n.astype(np.int32).tobytes()), _squeeze(run_len[pick].tobytes()), _squeeze(run_doc[pick].tobytes()), _squeeze(run_start[pick].tobytes())))
        return pa.Table.from_batches([_batch(schema, out)], schema=schema)

    names = [f.name for f in result.fields]

    def removes(key, left: pa.Table, right: pa.Table) -> pa.Table:
        notes = right.to_pylist()
        parts = []
        for raw in left.column("docs"):
            docs_ = _unpack(raw.as_py())
            texts = _texts(docs_, text_col)
            _, counts = kind.units(texts)
            gone = np.zeros(int(counts.sum()), bool)
            places = [r for r in notes if r["kind"] == 1]
            if places:
                seg, row, first = (np.frombuffer(_open(places[0][x]), np.int32).astype(np.int64) for x in "abc")
                told = sorted((r for r in notes if r["kind"] == 2), key=lambda r: r["shard"])
                runs, length = (np.concatenate([np.frombuffer(_open(r[x]), np.int32) for r in told]).astype(np.int64) for x in "ab")
                doc, start = (np.concatenate([np.frombuffer(_open(r[x]), np.int64) for r in told]) for x in "cd")
                base = np.cumsum(runs) - runs
                before = np.cumsum(length) - length  # of each run, windows before it; less those before its segment
                lead = before - np.repeat(before[np.minimum(base, len(before) - 1)], runs)
                n = runs[seg]
                pick = np.repeat(base[seg] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at = np.repeat(first, n) + lead[pick]
                mine, mine_start = np.repeat(_doc_ids(docs_, id_col)[row], n), at - np.repeat((np.cumsum(counts) - counts)[row], n)
                early = doc[pick] < mine
                if kind.by_place:
                    early |= (doc[pick] == mine) & (start[pick] < mine_start)
                lo, hi = at[early], at[early] + length[pick][early] - 1 + kind.length
                step = np.bincount(lo, minlength=len(gone) + 1) - np.bincount(hi, minlength=len(gone) + 1)
                gone = np.cumsum(step)[: len(gone)] > 0
            parts.append(finish(docs_, texts, counts, gone))
        return pa.Table.from_batches(parts).select(names)

    shared = blocks.select("block", "docs").mapInArrow(trimmed_batches(anchors), ANCHOR_TYPE).groupBy("shard").applyInArrow(trimmed(bits), BIT_TYPE)
    sent, _ = written(blocks.select("block", "docs").groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(trimmed_pair(sends), SEGMENT_TYPE), f"{name}-segments")
    told = sent.where("kind = 0").groupBy("shard").applyInArrow(trimmed(answers), NOTE_TYPE)
    kept = sent.where("kind = 1").select("block", "kind", "shard", F.col("lens").alias("a"), F.col("docs").alias("b"), F.col("starts").alias("c"), F.lit(None).cast("binary").alias("d"))
    return blocks.select("block", "docs").groupBy("block").cogroup(told.unionByName(kept).groupBy("block")).applyInArrow(trimmed_pair(removes), result)
