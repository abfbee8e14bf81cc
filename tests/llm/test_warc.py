import base64
import gzip
import hashlib
import random

import pytest

from graphloom.llm import warc


def sha1(data):
    return hashlib.sha1(data).hexdigest()


def record(i, body=b"hello", kind="response", refers=None):
    return warc.record_bytes(f"urn:page:{i}", kind, "http://x/\n", body, sha1(body), refers, "2020-01-01T00:00:00Z")


def ids(items):
    return [f["record_id"] for kind, _, _, f in items if kind == "record"]


def covered(items, data):
    """Records and gaps follow one another and leave out nothing but padding."""
    at = 0
    for _, start, end, _ in items:
        assert start >= at and not data[at:start].strip(b"\x00\r\n")
        at = end
    assert not data[at:].strip(b"\x00\r\n")


def test_good_members_and_plain_records():
    members = [warc.gzip_member(record(i, b"x" * i)) for i in range(5)]
    data = b"\x00".join(members)
    items = list(warc.salvage(data))
    assert ids(items) == [f"urn:page:{i}" for i in range(5)] and all(k == "record" for k, *_ in items)
    assert gzip.decompress(b"".join(members)) == b"".join(record(i, b"x" * i) for i in range(5))
    plain = b"".join(record(i) for i in range(4))
    assert ids(warc.salvage(plain)) == [f"urn:page:{i}" for i in range(4)]
    covered(items, data)
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"\x00\x00")) == []


def test_damage_costs_only_what_is_damaged():
    members = [warc.gzip_member(record(i, bytes([65 + i]) * 3000)) for i in range(6)]
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + members[1] + bytes(broken) + members[3] + b"garbage\x1f\x8b\x08more" + members[4] + members[5][:-5]
    items = list(warc.salvage(data))
    assert ids(items) == [f"urn:page:{i}" for i in (0, 1, 3, 4)]
    gaps = [(s, e) for k, s, e, _ in items if k == "gap"]
    a = len(members[0]) + len(members[1])
    assert gaps[0] == (a, a + len(broken)) and len(gaps) == 3 and gaps[-1][1] == len(data)
    covered(items, data)


def test_plain_damage():
    one, two, three = record(1), record(2, b"WARC/1.1\r\ninside"), record(3)
    assert ids(warc.salvage(one.replace(b"hello", b"jello") + two + three)) == ["urn:page:2", "urn:page:3"]
    wrong = one.replace(b"\r\n\r\nHTTP", b"\r\nNo colon here\r\n\r\nHTTP", 1)
    assert ids(warc.salvage(b"junk" + two + wrong + three)) == ["urn:page:2", "urn:page:3"]
    assert ids(warc.salvage(one[:-10])) == [] and ids(warc.salvage(two[:40] + one)) == ["urn:page:1"]


def test_random_cuts_never_lose_later_records():
    rng = random.Random(0)
    members = [warc.gzip_member(record(i, bytes(rng.randrange(256) for _ in range(rng.randrange(400))))) for i in range(12)]
    for _ in range(60):
        hit = rng.randrange(12)
        m = bytearray(members[hit])
        cut = rng.randrange(len(m))
        m = m[:cut] if rng.random() < 0.5 else m[:cut] + bytes([m[cut] ^ (1 << rng.randrange(8))]) + m[cut + 1 :]
        data = b"".join([*members[:hit], bytes(m), *members[hit + 1 :]])
        items = list(warc.salvage(data))
        assert set(ids(items)) >= {f"urn:page:{i}" for i in range(12) if i != hit}
        covered(items, data)


def noise(i):
    return random.Random(i).randbytes(900)


@pytest.mark.parametrize("window", [64, 32 << 20])
@pytest.mark.parametrize("level", [0, 4])
def test_members_of_many_records(monkeypatch, window, level):
    monkeypatch.setattr(warc, "WINDOW", window, raising=False)
    parts = [record(i, noise(i)) for i in range(200)]
    names = [f"urn:page:{i}" for i in range(200)]
    parts[7] = parts[7].replace(noise(7), noise(7)[::-1])
    whole, tail = warc.gzip_member(b"".join(parts), level), warc.gzip_member(record(500))
    items = list(warc.salvage(whole + tail))
    assert ids(items) == names[:7] + names[8:] + ["urn:page:500"]
    gaps = [x for x in items if x[0] == "gap"]
    start = sum(map(len, parts[:7]))
    assert [(s, e, f["inner_start"], f["inner_end"]) for _, s, e, f in gaps] == [(0, len(whole), start, start + len(parts[7]))]
    cut = list(warc.salvage(whole[: len(whole) // 2] + tail))
    found = ids(cut)
    assert len(found) > 90 and found == [x for x in names if x != names[7]][: len(found) - 1] + ["urn:page:500"]
    assert cut[-2][0] == "gap" and cut[-2][1] == cut[0][2] and cut[-2][2] == len(whole) // 2
    bad_sum = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    assert ids(warc.salvage(bad_sum + tail)) == names[:7] + names[8:] + ["urn:page:500"]


def test_long_records_and_headers(monkeypatch):
    monkeypatch.setattr(warc, "WINDOW", 1000, raising=False)
    url = "http://x/" + "y" * 200_000
    long = warc.record_bytes("urn:page:1", "response", url, b"hello", sha1(b"hello"), None, "2020-01-01T00:00:00Z")
    for data in (long + record(2), warc.gzip_member(long) + warc.gzip_member(record(2)), warc.gzip_member(long + record(2))):
        items = list(warc.salvage(data))
        assert ids(items) == ["urn:page:1", "urn:page:2"] and items[0][3]["target_uri"] == url
    monkeypatch.setattr(warc, "MAX_RECORD_BYTES", 50_000)
    assert ids(warc.salvage(warc.gzip_member(b"".join(record(i, noise(i)) for i in range(100))))) == [f"urn:page:{i}" for i in range(100)]


def test_round_trip_of_pages(spark, tmp_path):
    rows = [(1, "http://a/é", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 10), (None, "u", "same"), (2, "u", "same"), (None, "u", "lonely"), (6, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    read = warc.read_archives(spark, path, glob="part-*")
    assert read.where("kind = 'gap'").count() == 0
    got = sorted(((warc_id(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, warc_id(r.refers_to)) for r in read.collect()), key=str)
    digest = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    chosen = {"same": 2, "": 4, "é" * 10: 5, "lonely": None, "x" * 300_000: 6}
    want = []
    for i, _, html in rows:
        best = chosen[html or ""]
        alone = html == "lonely" or i == best
        want.append((i, len((html or "").encode()), digest(html), "response" if alone else "revisit", None if alone else best))
    assert got == sorted(want, key=str)
    payload = {warc_id(r.record_id): bytes(r.payload) for r in read.where("record_type = 'response'").collect()}
    assert payload[5] == ("é" * 10).encode() and payload[4] == b""
    empty = str(tmp_path / "e")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0
    small = str(tmp_path / "s")
    warc.write_archives(pages, small, min_revisit_bytes=5)
    assert warc.read_archives(spark, small, glob="part-*").where("record_type = 'revisit'").count() == 0


def warc_id(x):
    tail = x.rpartition(":")[2] if x else None
    return int(tail) if tail and tail != "None" else None


def test_false_heads_cost_little():
    """Starts of members that are none, one in 64 bytes, then a record: found, and in a time that grows with the bytes."""
    import random
    import time

    r = random.Random(2)
    noise = b"".join(warc.GZIP_MAGIC + r.randbytes(61) for _ in range(1 << 15))
    record = warc.gzip_member(warc.record_bytes("urn:page:1", "response", "http://x", b"kept " * 50, hashlib.sha1(b"kept " * 50).hexdigest(), None, "2024-01-01T00:00:00Z"))
    start = time.monotonic()
    found = [(kind, a, b) for kind, a, b, _ in warc.salvage(noise + record + noise[:640] + record)]
    assert [x for x in found if x[0] == "record"] == [("record", len(noise), len(noise) + len(record)), ("record", len(noise) + len(record) + 640, len(noise) + 2 * len(record) + 640)]
    assert time.monotonic() - start < 20
