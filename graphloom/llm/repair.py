"""Repair of the structure of conversations by the cheapest edits.

A conversation is well formed when its roles are nothing, or a system row at most and then user and assistant in turn. Its edit lattice has a
node for every row and state of that rule, and edges that keep, rerole or delete the row or insert one before it. Two heaps go through
it, one from the start and one from the ends, until no path as cheap as the best can be left; all crossings of that cost are then at hand,
and one walk over them takes the least edit at each node. The edits spelt lead to one node only and no spelling of a node's cheapest paths
begins another, so that walk's spelling is the least.

Rows are put in order by ranges of (conversation, turn, role, digest of text), so that a long conversation spans tasks. A row is one byte from
there on: its role's initial and its first fault. A conversation within one block of rows is solved at once. Of a longer one each block gives
the cheapest edits between its four states, in parallel, and the blocks are the rows of a coarser lattice that the same search solves: one
task has a byte per row there, which the conversation's audit, one cell of the result, has too. Texts are hashed in order by a task that
reads them as a sorted stream and holds one batch.

A null role or text is one space; a null turn comes first. Rows of one turn come by role, then by digest of text; repeated rows beside each
other, the later ones duplicates. An empty role has no initial and cannot be kept. A null conversation is one of its own. Empty texts are
blank, texts of any length are hashed as they are, an empty table gives an empty one, and other columns are not looked at.
"""

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.batches import small_batches, trimmed, trimmed_batches
from graphloom.sources.tables import cut

WHITE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
BLOCK = 2048  # rows of a block
ROWS = 4096  # rows of an Arrow batch, at most

# Roles by initial, faults, and states: nothing yet, after system, after user, after assistant.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
STATES, ENDS = range(4), (0, 3)
INSERTED = (2, 2, 3, 2)  # the state after a row of the role that a state asks for
KEPT = {(SYSTEM, 0): 1, (USER, 0): 2, (USER, 1): 2, (USER, 3): 2, (ASSISTANT, 2): 3}
NAMES = {2: "user", 3: "assistant"}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1


def cheapest(after: Callable, before: Callable, start: int, ends: Iterable[int]) -> tuple[int, list[str]] | None:
    """The least cost of a way from ``start`` to one of ``ends`` and its labels, the least of the cheapest ways; None if there is none.
    ``after`` and ``before`` give (label, cost, node) of the edges out of a node and into it; costs are not negative, and an end has no edge of
    cost 0. Labels of edges out of a node are told apart by their first difference."""
    ends = set(ends)
    sides = [(after, {start: 0}, {}, [(0, start)]), (before, dict.fromkeys(ends, 0), {}, [(0, e) for e in ends])]
    heapq.heapify(sides[1][3])
    best = 0 if start in ends else None
    while sides[0][3] and sides[1][3] and (best is None or sides[0][3][0][0] + sides[1][3][0][0] <= best):
        way = 0 if sides[0][3][0][0] <= sides[1][3][0][0] else 1
        edges, found, settled, heap = sides[way]
        met = sides[1 - way][1]
        cost, node = heapq.heappop(heap)
        if node in settled:
            continue
        settled[node] = cost
        for _, more, to in edges(node):
            if cost + more < found.get(to, 1 << 62):
                found[to] = cost + more
                heapq.heappush(heap, (cost + more, to))
                if to in met and (best is None or cost + more + met[to] < best):
                    best = cost + more + met[to]
    if best is None:
        return None
    there, back = sides[0][2], sides[1][2]
    # nodes of the forward side on a cheapest way: those with an edge to the other side, or an end, and those that lead to them
    on = {u for u, c in there.items() if (u in ends and c == best) or any(v in back and c + w + back[v] == best for _, w, v in after(u))}
    todo = list(on)
    while todo:
        v = todo.pop()
        for _, w, u in before(v):
            if u not in on and u in there and there[u] + w == there[v]:
                on.add(u)
                todo.append(u)
    out, node, cost = [], start, 0
    while not (node in ends and cost == best):
        label, more, node = min((x, w, v) for x, w, v in after(node) if (v in back and cost + w + back[v] == best) or (v in on and cost + w == there[v]))
        out.append(label)
        cost += more
    return best, out


def _edges(code: int) -> list[list[tuple[str, int, int]]]:
    """Of each state, the edges that consume a row of this code."""
    role, fault = code & 3, code >> 2
    out = []
    for q in STATES:
        mine = [("D", DELETE, q)]
        if fault not in (BLANK, DUPLICATE):
            more = CUT_OFF if fault == TRUNCATED else 0
            mine.append(("R", REROLE + more, INSERTED[q]))
            if (role, q) in KEPT:
                mine.append(("K", more, KEPT[role, q]))
        out.append(mine)
    return out


AFTER = [_edges(code) for code in range(16)]
BEFORE = [[[(x, w, q) for q in STATES for x, w, to in AFTER[code][q] if to == at] for at in STATES] for code in range(16)]
INSERTS_INTO = [[("I", INSERT, q) for q in STATES if INSERTED[q] == at] for at in STATES]


def repair(codes: bytes, start: int = 0, ends: Iterable[int] = ENDS, open_end: bool = True) -> tuple[int, str] | None:
    """The least cost and the audit of a run of rows between states; ``open_end`` allows inserts after the last row."""
    n = len(codes)

    def after(node: int):
        i, q = node >> 2, node & 3
        if i < n:
            yield from ((x, w, (i + 1) << 2 | to) for x, w, to in AFTER[codes[i]][q])
        if i < n or open_end:
            yield "I", INSERT, i << 2 | INSERTED[q]

    def before(node: int):
        i, q = node >> 2, node & 3
        if i:
            yield from ((x, w, (i - 1) << 2 | at) for x, w, at in BEFORE[codes[i - 1]][q])
        if i < n or open_end:
            yield from ((x, w, i << 2 | at) for x, w, at in INSERTS_INTO[q])

    found = cheapest(after, before, start, [n << 2 | q for q in ends])
    return found and (found[0], "".join(found[1]))


@lru_cache(maxsize=1 << 16)
def whole(codes: bytes) -> tuple[int, str]:
    return repair(codes)


def block_map(codes: bytes) -> list[tuple[int, int, int, str]]:
    """``(from, to, cost, audit)`` of a block of rows between its states; inserts behind its last row belong to the next block."""
    return [(s, t, *found) for s in STATES for t in STATES if (found := repair(codes, s, [t], False))]


def joined(maps: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """The repair of a conversation from the maps of its blocks."""
    n = len(maps)
    out = [[[(x, w, t) for s, t, w, x in m if s == q] for q in STATES] for m in maps]
    into = [[[(x, w, s) for s, t, w, x in m if t == q] for q in STATES] for m in maps]

    def after(node: int):
        i, q = node >> 2, node & 3
        if i < n:
            return [(x, w, (i + 1) << 2 | t) for x, w, t in out[i][q]]
        return [("I", INSERT, i << 2 | INSERTED[q])]

    def before(node: int):
        i, q = node >> 2, node & 3
        edges = [(x, w, (i - 1) << 2 | s) for x, w, s in into[i - 1][q]] if i else []
        return edges + ([(x, w, i << 2 | s) for x, w, s in INSERTS_INTO[q]] if i == n else [])

    cost, labels = cheapest(after, before, 0, [n << 2 | q for q in ENDS])
    return cost, "".join(labels)


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, text, copies)`` of rows of which a fifth are damaged, by a checksum of ``conv:turn``: dropped, emptied, rid of stops,
    repeated, or given to the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _digest() -> Column:
    """Of role and text: equal just when both are."""
    return F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of codes from rows in order; of rows that repeat the one before, all but the first are duplicates."""
    part, seq, last, held = TaskContext.get().partitionId(), 0, None, bytearray()
    convs: list = []
    out: list[tuple] = []

    def flush():
        nonlocal held, seq
        if held:
            convs.append(last[0])
            out.append((part, seq, bytes(held)))
            seq, held = seq + 1, bytearray()

    def batch():
        a, b, c = zip(*out, strict=True)
        made = pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["conv", "part", "seq", "codes"])
        convs.clear()
        out.clear()
        return made

    kind = pa.null()
    for rows in batches:
        kind = rows.column("conv").type
        for conv, turn, digest, copies, code, later in zip(*(rows.column(c).to_pylist() for c in ("conv", "turn", "digest", "copies", "code", "later")), strict=True):
            if last is not None and conv != last[0]:
                flush()
            same = last == (conv, turn, digest)
            last = (conv, turn, digest)
            for i in range(copies):
                fault = code >> 2
                held.append(code & 3 | (BLANK if fault == BLANK else DUPLICATE if later or same or i else fault) << 2)
                if len(held) >= BLOCK:
                    flush()
        if len(out) >= ROWS:
            yield batch()
    flush()
    if out:
        yield batch()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks: counts of faults and of illegal neighbours, the first and the last role, and the audit (of a conversation of one block) or the
    map between states."""
    for rows in batches:
        out = []
        for codes, blocks in zip(*(rows.column(c).to_pylist() for c in ("codes", "blocks")), strict=True):
            faults = [c >> 2 for c in codes]
            roles = [c & 3 for c in codes]
            illegal = sum(x not in LEGAL for x in zip(roles, roles[1:], strict=False))
            cost, audit = whole(codes) if blocks == 1 else (None, None)
            ways = None if blocks == 1 else [dict(zip(("s", "t", "cost", "audit"), x, strict=True)) for x in block_map(codes)]
            out.append((faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, roles[0], roles[-1], cost, audit, ways))
        types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]
        columns = zip(*out, strict=True) if out else [()] * len(types)
        yield pa.RecordBatch.from_arrays([rows.column("conv"), rows.column("idx"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["conv", "idx", *SOLVED])


SOLVED = ("blank", "duplicate", "truncated", "illegal", "head", "tail", "cost", "audit", "ways")
STATS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _joined(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("idx")
    head, tail = (rows.column(c).to_pylist() for c in ("head", "tail"))
    sums = [sum(rows.column(c).to_pylist()) for c in ("blank", "duplicate", "truncated", "illegal")]
    sums[3] += sum(x not in LEGAL for x in zip(tail, head[1:], strict=False))
    cost, audit = joined([[(w["s"], w["t"], w["cost"], w["audit"]) for w in ways] for ways in rows.column("ways").to_pylist()])
    values = [pa.array([x], pa.int64()) for x in (*sums, cost)] + [pa.array([audit], pa.string())]
    return pa.table([rows.column("conv").slice(0, 1), *values], ["conv", *(f.split()[0] for f in STATS.split(", "))])


def audits(rows: DataFrame) -> DataFrame:
    """``(conv, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation with rows. ``rows``: conv, turn, role, text, copies."""
    spark = rows.sparkSession
    kind = rows.schema["conv"].dataType.simpleString()
    kept = F.rtrim(F.col("text"), F.lit(WHITE))
    role = F.substring("role", 1, 1)
    initial = F.when(role == "s", SYSTEM).when(role == "u", USER).when(role == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(kept == "", BLANK).when(~F.right(kept, F.lit(1)).isin(*STOPS), TRUNCATED).otherwise(FINE)
    marked = cut(rows.select("conv", "turn", "role", _digest().alias("digest"), "copies", (initial + 4 * fault).cast("int").alias("code")), "repair-rows")
    first = marked.groupBy(F.col("conv").alias("__conv"), F.col("digest").alias("__digest")).agg(F.min(F.struct("turn")).alias("first"))
    met = marked.join(first, F.expr("conv <=> __conv AND digest = __digest")).select("conv", "turn", "role", "digest", "copies", "code", (F.struct("turn") > F.col("first")).alias("later"))
    met = cut(met, "repair-marked")  # ranges are taken from a sample first
    ordered = met.repartitionByRange("conv", "turn", "role", "digest").sortWithinPartitions("conv", "turn", "role", "digest")
    blocks = ordered.mapInArrow(trimmed_batches(_packed), f"conv {kind}, part int, seq long, codes binary")
    mine = Window.partitionBy("conv")
    blocks = blocks.select("conv", "codes", F.count(F.lit(1)).over(mine).alias("blocks"), F.row_number().over(mine.orderBy("part", "seq")).alias("idx"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ways = "array<struct<s: int, t: int, cost: long, audit: string>>"
    solved = blocks.repartition(tasks, "conv", "idx").mapInArrow(_solved, f"conv {kind}, idx int, blank long, duplicate long, truncated long, illegal long, head int, tail int, cost long, audit string, ways {ways}")
    solved = cut(solved, "repair-solved")
    one = solved.where("ways IS NULL").select("conv", *(f.split()[0] for f in STATS.split(", ")))
    long = solved.where("ways IS NOT NULL").groupBy("conv").applyInArrow(trimmed(_joined), f"conv {kind}, {STATS}")
    return one.unionByName(long)


def repaired(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``heads`` (conv, audit and what more they have) with ``repaired_sha256``: of the repaired ``role:text``, one to a line. Each head comes
    before its rows in a stream sorted by conversation."""
    kind = rows.schema["conv"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    lead = heads.select("conv", F.lit(0).alias("line"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), F.lit(1).alias("copies"), "audit")
    body = rows.select("conv", F.lit(1).alias("line"), "turn", "role", _digest().alias("digest"), "text", "copies", none("string").alias("audit"))
    stream = lead.unionByName(body).repartition("conv").sortWithinPartitions("conv", "line", "turn", "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_, edits, state, some, conv = None, iter(""), 0, False, None
        done: list[tuple] = []
        type_ = pa.null()

        def say(role: str, text: str) -> None:
            nonlocal some
            hash_.update((("\n" if some else "") + role + ":" + text).encode())
            some = True

        def inserts() -> str | None:
            """The next edit of a row, after the inserts before it."""
            nonlocal state
            for e in edits:
                if e != "I":
                    return e
                state = INSERTED[state]
                say(NAMES[state], "")
            return None

        def finish() -> None:
            if hash_ is not None:
                inserts()
                done.append((conv, hash_.hexdigest()))

        def made() -> pa.RecordBatch:
            a, b = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, type_), pa.array(b, pa.string())], ["conv", "repaired_sha256"])

        for batch in batches:
            type_ = batch.column("conv").type
            for id_, line, role, text, copies, audit in zip(*(batch.column(c).to_pylist() for c in ("conv", "line", "role", "text", "copies", "audit")), strict=True):
                if line == 0:
                    finish()
                    hash_, edits, state, some, conv = hashlib.sha256(), iter(audit), 0, False, id_
                    continue
                for _ in range(copies):
                    edit = inserts()
                    if edit == "R":
                        state = INSERTED[state]
                        say(NAMES[state], text)
                    elif edit == "K":
                        initial = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                        state = KEPT[initial, state]
                        say(role, text)
            if len(done) >= ROWS:
                yield made()
        finish()
        if done:
            yield made()

    return stream.select("conv", "line", "role", "text", "copies", "audit").mapInArrow(trimmed_batches(run), f"conv {kind}, repaired_sha256 string")


def repair_conversations(original: DataFrame, rows: DataFrame) -> DataFrame:
    """Every ``conv`` of ``original`` with ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256`` of
    its ``rows`` (conv, turn, role, text, copies); without rows zeros, an empty audit and the hash of nothing."""
    small_batches(rows.sparkSession)
    turns = rows.where("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    whole_ = lambda df: df.select("conv", *(F.col(c) if c in df.columns else F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in (*counts, "audit")))
    # one group for all that is known of a conversation: a null one meets itself
    known = whole_(original.select("conv").distinct()).unionByName(whole_(turns)).unionByName(whole_(audits(rows)))
    zero = [F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in counts]
    heads = cut(known.groupBy("conv").agg(*zero, F.coalesce(F.max("audit"), F.lit("")).alias("audit")), "repair-heads")
    hashes = repaired(rows, heads).withColumnRenamed("conv", "__conv")
    return heads.join(hashes, F.expr("conv <=> __conv")).drop("__conv")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_conversations(rows.select(F.col("conv_id").alias("conv")), damage(rows)).withColumnRenamed("conv", "conv_id")
