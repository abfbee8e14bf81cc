"""Chat formatting: tool calls and their results, linked by identifier, topologically ordered, validated and serialised.

Calls and results are joined by (conversation, identifier) with a shuffled hash join whose results have been reduced to one row per
identifier, so a conversation or identifier with a third of all rows is never gathered, nor multiplied. References between calls
(``{"$ref": "<call id>"}`` anywhere in the arguments) are read from the parsed JSON. A conversation's references are ordered in one
task, however deep, as long as they are at most ``GROUP``; beyond that its levels are peeled, one join per level, to the same result.
"""

import json
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import cut, drop_path, written

KEYS = ["conv_id", "call_id"]
GROUP = 100_000  # references of a conversation that one task orders
DEPTH = 200  # nesting of JSON values

CALL_MESSAGE = "tool_calls array<struct<id: string, name: string, arguments: string>>"
RESULT_MESSAGE = "tool_call_id string, content string"


def calls_of(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results of chat messages whose text is JSON: ``{"tool_calls": [{"id", "name", "arguments"}]}`` of the assistant and
    ``{"tool_call_id", "content"}`` of the tool. Other messages, and text that is no such JSON, give no rows."""
    base = messages.select(F.col(conv_col).cast("string").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    made = base.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", CALL_MESSAGE)["tool_calls"]).alias("c"))
    calls = made.select("conv_id", F.col("c.id").alias("call_id"), "turn", F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments"))
    told = base.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", RESULT_MESSAGE).alias("r"))
    return calls, told.where("r.tool_call_id is not null").select("conv_id", F.col("r.tool_call_id").alias("call_id"), "turn", F.col("r.content").alias("content"))


def references(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, ref)``: the identifiers that a call's arguments refer to, each once. Malformed arguments refer to none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, str]] = []
            for conv, call, raw in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "call_id", "arguments")), strict=True):
                try:
                    value = load(raw)
                except ValueError:
                    continue
                found, todo = set(), [value]
                while todo:
                    x = todo.pop()
                    if isinstance(x, dict):
                        if isinstance(x.get("$ref"), str):
                            found.add(x["$ref"])
                        todo += x.values()
                    elif isinstance(x, list):
                        todo += x
                rows += [(conv, call, r) for r in sorted(found) if not SURROGATE.search(r)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], [*KEYS, "ref"])

    likely = F.col("arguments").contains("$ref") | F.col("arguments").contains("\\u00")  # a key may be escaped
    return calls.where(likely).select(*KEYS, "arguments").mapInArrow(run, "conv_id string, call_id string, ref string")


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of the calls that refer to other calls of their conversation: one more than the highest level
    among these; null on a cycle or behind one. ``calls``: identifiers with arguments; the references of all rows of one count. References to
    unknown calls do not.
    """
    known = calls.select("conv_id", F.col("call_id").alias("ref"))
    edges = cut(references(calls).join(known, ["conv_id", "ref"], "left_semi"), "calls-edges")
    large = cut(edges.groupBy("conv_id").count().where(F.col("count") > GROUP).select("conv_id"), "calls-large")
    found = edges.join(large, "conv_id", "left_anti").groupBy("conv_id").applyInArrow(_ordered, "conv_id string, call_id string, level int")
    return found if large.isEmpty() else found.unionByName(_peeled(edges.join(large, "conv_id", "left_semi")))


def _ordered(table: pa.Table) -> pa.Table:
    """Levels of one conversation's calls, from those whose references are all known on."""
    users, waits = defaultdict(list), defaultdict(int)
    pairs = list(zip(table.column("call_id").to_pylist(), table.column("ref").to_pylist(), strict=True))
    for call, ref in pairs:
        users[ref].append(call)
        waits[call] += 1
    level = {ref: 0 for _, ref in pairs if ref not in waits}
    todo = list(level)
    while todo:
        ref = todo.pop()
        for call in users[ref]:
            level[call] = max(level.get(call, 0), level[ref] + 1)
            waits[call] -= 1
            if not waits[call]:
                todo.append(call)
    calls = sorted(waits)
    return pa.table({"conv_id": pa.array([table.column("conv_id")[0].as_py()] * len(calls), pa.string()), "call_id": pa.array(calls, pa.string()), "level": pa.array([None if waits[c] else level[c] for c in calls], pa.int32())})


def _peeled(edges: DataFrame) -> DataFrame:
    """Levels by a join per level."""
    edges = cut(edges, "calls-edges")
    state, old = written(edges.select(*KEYS).distinct().withColumn("level", F.lit(None).cast("int")), "calls-levels")
    before = -1
    while True:
        of_ref = state.select("conv_id", F.col("call_id").alias("ref"), F.col("level").alias("ref_level"), F.lit(True).alias("refers"))
        seen = edges.join(of_ref, ["conv_id", "ref"], "left").withColumn("ref_level", F.when(F.col("refers").isNull(), F.lit(0)).otherwise(F.col("ref_level")))
        stepped = seen.groupBy(*KEYS).agg(F.when(F.count("ref_level") == F.count(F.lit(1)), F.max("ref_level") + 1).cast("int").alias("level"))
        state, path = written(stepped, "calls-levels")
        drop_path(state.sparkSession, old)
        old = path
        found = state.where("level is not null").count()
        if found == before:
            return state
        before = found


_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def check(value, schema: Mapping, path: str = "$") -> str | None:
    """The first fault of a value against a JSON schema (type, enum, required, properties, additionalProperties, items, minimum,
    maximum, minLength, maxLength, minItems, maxItems), or None. A ``$ref`` to a call stands for any value."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return None
    kinds = schema.get("type")
    if kinds:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        fits = [number and (k == "number" or isinstance(value, int) or value.is_integer()) if k in ("number", "integer") else isinstance(value, _KINDS[k]) for k in ([kinds] if isinstance(kinds, str) else kinds)]
        if not any(fits):
            return f"{path}: not of type {kinds}"
    if "enum" in schema and canonical(value) not in {canonical(x) for x in schema["enum"]}:
        return f"{path}: not one of the values"
    for name, low, size in (("minimum", True, None), ("maximum", False, None), ("minLength", True, str), ("maxLength", False, str), ("minItems", True, list), ("maxItems", False, list)):
        if name in schema:
            numeric = size is None and isinstance(value, (int, float)) and not isinstance(value, bool)
            measured = value if numeric else len(value) if size and isinstance(value, size) else None
            if measured is not None and (measured < schema[name] if low else measured > schema[name]):
                return f"{path}: {name} is {schema[name]}"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{path}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                if fault := check(value[name], known[name], f"{path}.{name}"):
                    return fault
            elif schema.get("additionalProperties", True) is False:
                return f"{path}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if fault := check(x, schema["items"], f"{path}[{i}]"):
                return fault
    return None


SURROGATE = re.compile("[\ud800-\udfff]")


def _escaped(text: str) -> str:
    """Text with lone surrogates, which UTF-8 cannot hold, as JSON escapes."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no white space, whole floats as integers and non-ASCII kept; lone surrogates stay escaped."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x

    return _escaped(json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def load(text: str):
    """The value of a JSON text. Raises :class:`ValueError` for malformed text, NaN and infinities, numbers beyond a double's range
    and values nested deeper than ``DEPTH``."""

    def refuse(name):
        raise ValueError("malformed JSON")

    def number(x):
        if abs(y := float(x)) == float("inf"):
            raise ValueError("number out of range")
        return y

    def whole(x):
        if len(x) > 309:
            number(x)
        return int(x)

    try:
        value = json.loads(text, parse_constant=refuse, parse_float=number, parse_int=whole)
    except json.JSONDecodeError:
        raise ValueError("malformed JSON") from None
    except RecursionError:
        raise ValueError("nested too deeply") from None
    nested = lambda values: [x for x in values if isinstance(x, (dict, list))]
    level, depth = nested([value]), 0
    while level:
        depth += 1
        if depth > DEPTH:
            raise ValueError("nested too deeply")
        level = [y for x in level for y in nested(x.values() if isinstance(x, dict) else x)]
    return value


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row per call, and one per result that is in no call's record.

    ``calls``: conv_id, call_id, turn, tool, arguments (JSON); ``results``: conv_id, call_id, turn, content. Other columns are
    ignored. ``status``: ``duplicate`` (an earlier turn has the identifier; calls of one turn
    and identifier stand beside each other, at one level), ``unanswered``, ``early`` (its first result is not behind
    it), ``linked``, ``extra`` (a result after the first of its call), or ``orphan`` (a result without a call). ``n_results``: the results of
    the identifier. ``level``: topological level within the conversation, 0 without references, null on or behind a cycle, and for
    results; (level, turn, call_id) is a topological order. ``valid`` and ``fault``: arguments against the tool's schema; malformed or null
    arguments, numbers beyond a double's range, deep nesting and unknown tools are faults, and such arguments stay as text. ``record``:
    canonical JSON of the call with its result, or of the result alone. A null conversation or identifier matches nothing: its calls are
    unanswered, its results orphans. Repeated rows are each returned. Empty tables give no rows.
    """
    calls = calls.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "tool", "arguments")
    results = results.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "content")
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    order = F.struct(F.coalesce("turn", F.lit(1 << 62)), "content")
    distinct = cut(results.groupBy(*KEYS, "turn", "content").agg(F.count(F.lit(1)).alias("n")), "calls-results")
    told = distinct.where(whole).groupBy(*KEYS).agg(F.min(order).alias("r"), F.sum("n").alias("n_results")).select(*KEYS, F.col("r.content").alias("result"), F.col("r.col1").alias("result_turn"), "n_results")
    first = calls.where(whole).groupBy(*KEYS).agg(F.min(F.struct(F.coalesce("turn", F.lit(1 << 62)).alias("turn"), "arguments")).alias("c")).select(*KEYS, F.col("c.turn").alias("first_turn"), F.col("c.arguments").alias("arguments"))
    first = cut(first, "calls-first")
    # calls of one identifier and turn that differ in their arguments: the references of all count
    openers = calls.where(whole).withColumn("at", F.coalesce("turn", F.lit(1 << 62))).join(first.select(*KEYS, F.col("first_turn").alias("at")), [*KEYS, "at"], "left_semi").select(*KEYS, "arguments").distinct()
    depth = levels(openers).withColumn("deep", F.lit(True))
    ids = cut(first.drop("arguments").join(depth, KEYS, "left").join(told, KEYS, "full"), "calls-ids")
    joined = calls.join(ids.where("first_turn is not null").hint("shuffle_hash"), KEYS, "left")
    status = F.when(F.col("turn") > F.col("first_turn"), "duplicate").when(F.col("n_results").isNull(), "unanswered").when(F.col("result_turn") <= F.col("first_turn"), "early").otherwise("linked")
    level = F.when(F.col("deep").isNull(), F.lit(0)).otherwise(F.col("level"))
    rows = joined.select(*KEYS, "turn", "tool", level.alias("level"), status.alias("status"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "arguments", F.when(status.isin("linked", "early"), F.col("result")).alias("result"))
    # results that no record holds: all but one of those equal to the first of a call
    rest = distinct.join(ids.select(*KEYS, F.col("first_turn").isNotNull().alias("called"), "n_results", F.col("result").alias("__first"), "result_turn"), KEYS, "left")
    held = F.coalesce("called", F.lit(False)) & F.col("content").eqNullSafe(F.col("__first")) & (F.coalesce("turn", F.lit(1 << 62)) == F.col("result_turn"))
    rest = rest.withColumn("left", F.col("n") - held.cast("int")).where("left > 0").withColumn("left", F.explode(F.sequence(F.lit(1), F.col("left"))))
    none = lambda t: F.lit(None).cast(t)
    bare = rest.select(*KEYS, "turn", none("string").alias("tool"), none("int").alias("level"), F.when(F.col("called"), "extra").otherwise("orphan").alias("status"), F.coalesce("n_results", F.lit(1)).alias("n_results"), none("string").alias("arguments"), F.col("content").alias("result"))
    schemas = {k: dict(v) for k, v in schemas.items()}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["conv_id", "call_id", "turn", "tool", "level", "status", "n_results"]
        for batch in batches:
            valid, faults, records = [], [], []
            for id_, tool, state, raw, result in zip(*(batch.column(c).to_pylist() for c in ("call_id", "tool", "status", "arguments", "result")), strict=True):
                try:
                    answer = load(result) if result is not None else None
                except ValueError:
                    answer = result
                if state in ("extra", "orphan"):
                    valid.append(None)
                    faults.append(None)
                    records.append(canonical({"id": id_, "result": answer, "status": state}))
                    continue
                try:
                    value = load(raw) if raw is not None else None
                    fault = "no arguments" if raw is None else "unknown tool" if tool not in schemas else check(value, schemas[tool])
                except ValueError as e:
                    value, fault = raw, str(e)
                valid.append(fault is None)
                faults.append(fault if fault is None else _escaped(fault))
                records.append(canonical({"id": id_, "name": tool, "arguments": value, "result": answer, "status": state}))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(valid, pa.bool_()), pa.array(faults, pa.string()), pa.array(records, pa.string())], [*kept, "valid", "fault", "record"])

    return rows.unionByName(bare).mapInArrow(finish, "conv_id string, call_id string, turn long, tool string, level int, status string, n_results long, valid boolean, fault string, record string")


def transcript_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: each user or system turn is a call (``reply``, ``configure``) whose identifier is its
    conversation and turn and which refers to the call of half its turn; each assistant turn is the result for the turn before."""
    id_ = lambda turn: F.concat_ws(":", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    half = F.floor(F.col("turn") / 2)
    after = F.when(F.col("turn") >= 2, F.array(F.struct(id_(half).alias("$ref"))))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn"), after.alias("after")))
    conv = F.col("conv_id").cast("string").alias("conv_id")
    calls = conversations.where("role in ('user', 'system')").select(conv, id_(F.col("turn")).alias("call_id"), "turn", F.when(F.col("role") == "user", "reply").otherwise("configure").alias("tool"), arguments.alias("arguments"))
    results = conversations.where("role = 'assistant'").select(conv, id_(F.col("turn") - 1).alias("call_id"), "turn", F.to_json(F.struct(F.col("text").alias("text"))).alias("content"))
    return calls, results


TRANSCRIPT_SCHEMAS = {
    "reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "array", "maxItems": 1}}},
    "configure": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string"}, "turn": {"type": "integer", "maximum": 0}}},
}


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = transcript_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link(calls, results, TRANSCRIPT_SCHEMAS)
