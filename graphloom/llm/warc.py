"""WARC writing and salvage reading.

Archives are gzip files with one member per record. They are written by Spark's own text writer (rows of raw
bytes, a zero byte after each block, which gzip readers take as padding), so any Hadoop file system will do, and
read as ``binaryFile`` rows, so the files need not be visible to Python. One file is one task's unit of work:
the writer keeps files near ``BLOCK_BYTES * BLOCKS_PER_FILE``.
"""

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import shared_path

# Fixed values of the WARC and gzip formats.
VERSION = b"WARC/1.1"
VERSION_STEM = b"WARC/1."
GZIP_MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BLOCK_BYTES = 4 << 20
BLOCKS_PER_FILE = 8
MAX_RECORD_BYTES = 512 << 20
FEED = 64 << 10
WINDOW = 32 << 20
FEED_PROBE, PROBE, STEP = 1024, 512, 16  # of a probe of a gzip head: bytes it reads, gives, and gives at a time

RECORD_SCHEMA = (
    "path string, start long, end long, kind string, reason string, record_id string, record_type string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary, inner_start long, inner_end long"
)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: str, record_type: str, uri: str | None, payload: bytes, sha1_hex: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record. A revisit carries the HTTP header of the full payload, so its length and digest, without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    head = [f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode())
    head.append("WARC-Block-Digest: sha1:" + digest(block))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row. Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, that with the largest
    id is a response and the others revisit it; smaller payloads are all responses. A null body is an empty payload, a null
    url leaves out the target URI. A row with a null id never becomes the response of a group that has an id; in a group
    without any id, and among rows that repeat the largest id, all are responses.

    The group's response is found by an aggregate over ``(digest, length)``, combined before the shuffle; joining it back
    has one row per digest on its small side, so a digest of a third of all rows is split by the adaptive skew join.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("sha1"))
    keys = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).alias("size"))
    chosen = keys.where(F.col("size") >= min_revisit_bytes).groupBy("sha1").agg(F.max("id").alias("chosen"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "chosen")
    linked = rows.join(chosen, "sha1", "left").withColumn("refers", F.when(F.col("chosen").isNotNull() & ~F.col("id").eqNullSafe(F.col("chosen")), F.col("chosen")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for id_, url, text, sha1, refers in zip(*(batch.column(c) for c in ("id", "url", "body", "sha1", "refers")), strict=True):
                to = refers.as_py()
                member = gzip_member(record_bytes(f"urn:page:{id_.as_py()}", "response" if to is None else "revisit", url.as_py(), text.as_py().encode(), sha1.as_py(), None if to is None else f"urn:page:{to}", date))
                parts.append(member)
                size += len(member)
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["block"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["block"])

    blocks = linked.select("id", "url", "body", "sha1", "refers").mapInArrow(pack, "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)


class Bad(Exception):
    """A failed check; its text is the reason logged for the gap. ``need``: the bytes from the record's start that could pass it."""

    def __init__(self, reason: str, need: int = 0):
        super().__init__(reason)
        self.need = need


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("malformed header line")
        out.setdefault(name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip())
    return out


def parse_record(data: bytes, at: int, end: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and where it ends. Raises :class:`Bad` when a check fails."""
    if data[at : at + len(VERSION_STEM)] != VERSION_STEM:
        raise Bad("no version line")
    line_end = data.find(b"\r\n", at, at + 32)
    head_end = data.find(b"\r\n\r\n", at, end)
    if head_end < 0:
        raise Bad("unterminated header", end - at + 1)
    if line_end < 0 or head_end <= line_end:
        raise Bad("unterminated header")
    head = _headers(data[line_end + 2 : head_end])
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Bad("bad content length")
    start, stop = head_end + 4, head_end + 4 + int(length)
    if stop + 4 > end or data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("block does not end where its length says", stop + 4 - at)
    block = data[start:stop]
    told = head.get("warc-block-digest", "")
    if told.lower().startswith("sha1:") and told[5:].upper() != digest(block):
        raise Bad("block digest differs")
    kind, payload, size = head.get("warc-type"), block, None
    if not kind or "warc-record-id" not in head:
        raise Bad("mandatory header missing")
    if head.get("content-type", "").startswith("application/http"):
        http_end = block.find(b"\r\n\r\n")
        if http_end < 0:
            raise Bad("unterminated HTTP header")
        payload = block[http_end + 4 :]
        lengths = [x.partition(b":")[2].strip() for x in block[:http_end].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(lengths[0]) if lengths and lengths[0].isdigit() else None
    told = head.get("warc-payload-digest", "").rpartition(":")[2].upper() or None
    if kind != "revisit":
        found = digest(payload)
        if told and told != found:
            raise Bad("payload digest differs")
        told, size = found, len(payload)
    bare = lambda x: x.strip("<>") if x is not None else None
    return {"record_id": bare(head["warc-record-id"]), "record_type": kind, "target_uri": head.get("warc-target-uri"), "refers_to": bare(head.get("warc-refers-to")), "payload_digest": told, "payload_bytes": size, "payload": None if kind == "revisit" else payload}, stop + 4


def _before_fault(inflate, piece: memoryview) -> bytes:
    """What a piece that does not decompress gives before the fault: the longest start that does, found by halving."""
    parts, at, step = [], 0, 1 << len(piece).bit_length()
    while step:
        trial = inflate.copy()
        try:
            part = trial.decompress(piece[at : at + step])
            inflate, at = trial, at + step
            parts.append(part)
        except zlib.error:
            pass
        step //= 2
    return b"".join(parts)


def _walk(data: bytes, at: int) -> Iterator[tuple[str, int, int, dict]]:
    """Records and gaps ``(kind, start, end, fields)`` of what the gzip member at ``at`` holds, by inner offset, and a last item ``end`` with
    the number of inner bytes, where the member ends in the file, and the fault that ended it, if any (then no gap stands last).

    The member is fed in small pieces and parsed by windows that grow to hold a record of up to ``MAX_RECORD_BYTES``.
    """
    inflate, view, pos, done, fault = zlib.decompressobj(31), memoryview(data), at, False, None
    buf, base, gap, why = b"", 0, None, ""
    while True:
        parts, size, want = [buf], len(buf), max(WINDOW, 2 * len(buf))
        while size < want and not done:
            piece = view[pos : pos + FEED]
            before = inflate.copy() if pos > at else None
            try:
                part = inflate.decompress(piece)
                fault = None if len(piece) or inflate.eof else "truncated member"
            except zlib.error:
                part, fault = _before_fault(before or zlib.decompressobj(31), piece), "member does not decompress"
            pos += len(piece)
            done = inflate.eof or fault is not None
            parts.append(part)
            size += len(part)
        buf, i = b"".join(parts), 0
        while i < len(buf):
            if gap is None and buf[i] in b"\x00\r\n":
                i += 1
                continue
            if not done and len(buf) - i < len(VERSION_STEM):
                break
            try:
                fields, stop = parse_record(buf, i, len(buf))
            except Bad as e:
                if not done and len(buf) - i < e.need <= MAX_RECORD_BYTES:
                    break
                if gap is None:
                    gap, why = base + i, str(e)
                ahead = buf.find(VERSION_STEM, i + 1)
                i = ahead if ahead >= 0 else len(buf) if done else max(i + 1, len(buf) - len(VERSION_STEM) + 1)
                continue
            if gap is not None:
                yield "gap", gap, base + i, {"reason": why}
                gap = None
            yield "record", base + i, base + stop, fields
            i = stop
        base, buf = base + i, buf[i:]
        if done:
            break
    if gap is not None and fault is None:
        yield "gap", gap, base, {"reason": why}
    yield "end", base, pos - len(inflate.unused_data), {"reason": fault}


def _hopeless(data: bytes, at: int) -> bool:
    """Whether what looks like a gzip head at ``at`` cannot begin a member with a record: it does not inflate as far as ``PROBE`` bytes, and what it
    gives has no version line. (Fewer bytes than ``STEP`` before the fault are not looked at; no record is as short.)"""
    inflate, out, piece = zlib.decompressobj(31), b"", data[at : at + FEED_PROBE]
    try:
        while len(out) < PROBE and not inflate.eof:
            part = inflate.decompress(piece, STEP)
            piece = inflate.unconsumed_tail
            if not part and not piece:
                return False
            out += part
    except zlib.error:
        return VERSION_STEM not in out
    return False


def _reach(data: bytes, at: int, size: int) -> int:
    """Where in the file the member at ``at`` has given ``size`` bytes."""
    inflate, out, view, pos, step = zlib.decompressobj(31), 0, memoryview(data), at, FEED
    while out < size:
        before = inflate.copy() if pos > at else zlib.decompressobj(31)
        try:
            n = len(inflate.decompress(view[pos : pos + step]))
        except zlib.error:
            n = size
        if step > 1 and out + n >= size:
            inflate, step = before, step // 16
            continue
        out, pos = out + n, pos + step
    return min(pos, len(data))


def _member(data: bytes, at: int) -> tuple[Iterator[tuple[str, int, int, dict]], int | None, str | None]:
    """Records and gaps of the gzip member at ``at`` (none if it has no record), where they end in the file (None: unknown), and the fault.

    Of a member that is cut or fails its own check, the records with valid checks of their own are kept, up to where the last one
    ends. Only a member that holds one record and nothing else stands or falls with its own check. Records beyond ``WINDOW``
    bytes are not held but parsed again.
    """
    items, size, solid, records, single, why, end = [], 0, 0, 0, None, "empty member", at
    for item in _walk(data, at):
        kind, start, stop, fields = item
        if kind == "end":
            total, end, fault = start, stop, fields["reason"]
            continue
        if kind == "record":
            solid, records, single = stop, records + 1, (start, stop)
        elif not records and size == 0:
            why = fields["reason"]
        size += stop - start
        if items is not None:
            items.append(item)
            if size > WINDOW:
                items = None
    if fault is not None and records == 1 and single == (0, total):
        records = 0
    if not records:
        return iter(()), end if fault is None else None, fault or why
    if items is None:
        items = (x for x in _walk(data, at) if x[0] != "end")
    if fault is not None:
        end = _reach(data, at, solid)
        borrowed = data.find(GZIP_MAGIC, max(at + 1, end - 8), end + 2)  # a cut record may end with bits of the next member's head
        end = min(end, borrowed) if borrowed >= 0 else end
    return iter(items), end, fault


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict]]:
    """Items ``(kind, start, end, fields)`` in file order: ``record`` or ``gap``. Gaps are the byte ranges that no valid record
    covers, but for zero padding between members and blank lines between plain records. After a failed check the search goes on at
    the next gzip magic or version line behind the failed start, so a false start costs no later record.

    Inside a gzip member the same search runs over the decompressed bytes: its records and gaps have the member's range and, as
    ``inner_start`` and ``inner_end``, that of the decompressed bytes. A member that is cut or fails its check ends with its last valid
    record; a gap follows (empty if another start does at once)."""
    pos, gap, why, n = 0, None, "", len(data)
    hits = dict.fromkeys((GZIP_MAGIC, VERSION_STEM), -1)  # the next of each, found once and kept until it is passed

    def ahead(first: int) -> int:
        for sought, hit in hits.items():
            if hit < first:
                found = data.find(sought, first)
                hits[sought] = found if found >= 0 else n
        return min(hits.values())

    while pos < n:
        if gap is None and data[pos] in b"\x00\r\n":
            pos += 1
            continue
        if data[pos : pos + 3] == GZIP_MAGIC:
            items, stop, fault = (iter(()), None, "member does not decompress") if _hopeless(data, pos) else _member(data, pos)
        else:
            try:
                fields, stop = parse_record(data, pos, n)
                items, fault = iter([("record", None, None, fields)]), None
            except Bad as e:
                items, stop, fault = iter(()), None, str(e)
        some = False
        for kind, start, end, fields in items:
            if gap is not None:
                yield "gap", gap, pos, {"reason": why}
                gap = None
            some = True
            yield kind, pos, stop, fields | {"inner_start": start, "inner_end": end}
        if fault is None:
            pos = stop
            continue
        if gap is None:
            gap, why = (stop if some else pos), fault
        if some or stop is None:
            pos = ahead(stop if some else pos + 1)
        else:
            pos = stop
    if gap is not None:
        yield "gap", gap, n, {"reason": why}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, glob: str = "*") -> DataFrame:
    """All records of the archives under ``path``, and a row of kind ``gap`` for every quarantined byte range.

    Empty files give no rows. ``start`` and ``end`` are byte offsets in the file (of the member, for gzip);
    ``inner_start`` and ``inner_end`` those in the member's decompressed bytes.
    """
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in RECORD_SCHEMA.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for kind, start, end, fields in salvage(content.as_py()):
                    row = dict.fromkeys(names) | fields | {"path": name.as_py(), "start": start, "end": end, "kind": kind}
                    if not with_payload:
                        row["payload"] = None
                    size += len(row["payload"] or b"")
                    rows.append(row)
                    if len(rows) >= 4096 or size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def page_id(column: str):
    """The page id in a record id of :func:`write_archives`; null for a page without one."""
    return F.regexp_extract(F.col(column), r"^urn:page:(-?\d+)$", 1).try_cast("long")


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = read_archives(spark, path, with_payload=False, glob="part-*").where("kind = 'record'")
    return found.select(page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS chosen FROM p GROUP BY h)
SELECT p.page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(p.h, CAST((i // 8) * 10 + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN p.page_id IS DISTINCT FROM g.chosen AND g.chosen IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM g.chosen THEN g.chosen END AS refers_to
FROM p JOIN g USING (h)
"""
