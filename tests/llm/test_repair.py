"""Repair of conversations against a plain version: damage by hand, then all edit sequences by cost and spelling."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import repair

WHITE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """(cost, audit) of rows (role, text, fault): a single search over (cost, audit)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if (i, roles) in seen:
            continue
        seen.add((i, roles))
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit
        ok = lambda r: re.fullmatch(r"s?(ua)*u?", r)
        tail = lambda r: r[-2:] if len(r) > 2 and r[-1] in "ua" else r
        nexts = []
        if i < len(rows):
            role, _, fault = rows[i]
            nexts.append((3, "D", i + 1, roles))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                nexts += [(2 + more, "R", i + 1, roles + r) for r in "ua"]
                if role[:1] in ("s", "u", "a"):
                    nexts.append((int(more), "K", i + 1, roles + role[0]))
        nexts += [(2, "I", i, roles + r) for r in "ua"]
        for w, op, j, r in nexts:
            if ok(r):
                short = r if len(r) <= 2 else ("ua" if r[-1] == "a" else "uau")
                heapq.heappush(heap, (cost + w, audit + op, j, short if not tail(r) == r else r))
    raise AssertionError


def plain(table):
    out, groups = {}, {}
    for conv, turn, role, text in table:
        one = lambda v: " " if v is None else v
        groups.setdefault(conv, [])
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            left = text.rstrip(WHITE)
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in rows if t is not None}
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_repair([(r[1], r[2], f) for r, f in zip(rows, faults)])
        lines, q, i = [], 0, 0
        for op in audit:
            needed = ["user", "user", "assistant", "user"][q]
            if op == "I":
                lines.append(needed + ":")
            elif op == "D":
                i += 1
                continue
            else:
                role = needed if op == "R" else rows[i][1]
                lines.append(f"{role}:{rows[i][2]}")
                i += 1
            q = {"s": 1, "u": 2, "a": 3}[lines[-1][0]]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


codes = st.lists(st.integers(0, 15), max_size=9).map(bytes)
NAMES, FAULTS = ["system", "user", "assistant", "tool"], ["", "blank", "duplicate", "truncated"]


@settings(max_examples=300, deadline=None)
@given(codes)
def test_least_cost_and_spelling(code):
    assert repair.repair(code) == plain_repair([(NAMES[c & 3], "", FAULTS[c >> 2]) for c in code])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 15), min_size=1, max_size=5).map(bytes), min_size=1, max_size=5))
def test_blocks_join_to_the_whole(parts):
    assert repair.joined([repair.block_map(p) for p in parts]) == repair.repair(b"".join(parts))


def write(spark, tmp_path, rows, schema="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("block", [2048, 3])
def test_query_against_plain(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    r = random.Random(5)
    texts = ["Yes.", "No!", "why?", "cut of", " ", "", None, "Ü ok.\n", "a.b.c", "…"]
    rows = []
    for conv in range(120):
        for turn in range(r.randint(1, 9)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            rows.append((conv, r.choice([turn, turn, turn, None, turn + 3]), role, r.choice(texts)))
    rows += [(None, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(7)] + rows[:20]
    rows += [(999, t, r.choice(["user", "assistant"]), r.choice(["a.", "b.", f"c{t}."])) for t in range(60)]
    assert got(repair.op11_conversation_repair(spark, write(spark, tmp_path, rows))) == plain(rows)


def test_dropped_conversation_empty_table_and_clashing_columns(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    path = write(spark, tmp_path / "a", [(gone, 0, "user", "hi.", 1)], "conv_id long, turn long, role string, text string, cost long")
    assert got(repair.op11_conversation_repair(spark, path)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(repair.op11_conversation_repair(spark, write(spark, tmp_path / "b", []))) == {}


def test_long_conversation_and_text(spark, tmp_path):
    rows = [(1, t, ("assistant", "user")[t % 2] if t % 7 else "user", f"say {t % 500}.") for t in range(5000)] + [(2, 0, "user", "long " * 500_000 + "."), (2, 1, "assistant", "x")]
    found = got(repair.op11_conversation_repair(spark, write(spark, tmp_path, rows)))
    want = plain(rows)
    assert found == want
