"""Operator 2: chat formatting with tool-call linking.

Texts may hold, in tags, calls ``<tool_call>{"id", "name", "arguments"}``,
results ``<tool_result>{"id", "content"}`` and schemas ``<tool_schema>{"name",
"parameters"}``. Each message and each tagged part becomes an event with its
canonical JSON (keys sorted by code point, no spaces, shortest numbers, text
unescaped where JSON allows, lone surrogates as escapes). Calls and results are
hash-joined by conversation and identifier, arguments are validated against the
schema of that name, and events get a topological place: a result comes after its
call, and a call after the calls whose results its arguments refer to
(``{"$result": id}``); sorting a conversation by (at_turn, at_level, turn, seq) is
the order. Nothing is gathered by conversation, so one of any length is no hot group.

Of calls with one identifier the first in the conversation counts, likewise of
results; of schemas of one name, the last. Calls get their places round by round,
each after all it refers to, until no call is left that could; there is no limit
to the length of a chain. What is left is in a cycle or waits for one: from the
other end those that nobody left refers to are peeled off likewise. Both keep their
own turn and say which they are.

Null role or text is null in the JSON; null ids are kept, and link with nothing. A
tagged part stays text if it isn't a JSON object of its kind, or is nested deeper
than ``DEEPEST``, or holds a number that JSON can't write (NaN, infinities, too
large). A schema whose own terms are of the wrong type is reported as a problem of
the call. Repeated rows give repeated events, of which the calls and results are
told apart from their twins by nothing, so all of them count as the first. Other
columns aren't read, and an empty table has no events.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, releasing, small_batches

_TAG = re.compile(r"<(tool_call|tool_result|tool_schema)>(.*?)</\1>", re.S)
#: Nested arrays and objects of a tagged part at most.
DEEPEST = 200
_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """Canonical JSON of a parsed value."""

    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
            return int(v)
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return v

    out = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


def parsed(text: str):
    """The value of a tagged part, or None if it isn't one that can be written again."""

    def number(digits: str) -> float:
        x = float(digits)
        if not math.isfinite(x):
            raise ValueError("no such number")
        return x

    def constant(name: str):
        raise ValueError(f"{name} isn't JSON")

    depth = most = 0
    for c in re.sub(r'"(?:[^"\\]|\\.)*+"', "", text, flags=re.S):
        depth += (c in "[{") - (c in "]}")
        most = max(most, depth)
    if most > DEEPEST:
        return None
    try:
        return json.loads(text, parse_float=number, parse_constant=constant)
    except ValueError:  # also for an integer of more digits than can be read
        return None


# JSON schema's type names.
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def problems(value, schema, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema`` (type, enum, properties, required,
    additionalProperties, items, minimum, maximum, minLength, maxLength), and which
    of these terms of the schema aren't of the type they should be."""
    if not isinstance(schema, dict):
        return []
    out: list[str] = []

    def term(name, kind, default):
        """A term of the schema, or the default where it is of another type."""
        got = schema.get(name)
        if got is None:
            return default
        if not isinstance(got, kind) or isinstance(got, bool) and kind is not bool:
            out.append(f"{at}: schema {name}")
            return default
        return got

    kinds = schema.get("type")
    if kinds is not None:
        def fits(kind):
            if kind in ("number", "integer"):
                return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
            return isinstance(kind, str) and kind in _TYPES and isinstance(value, _TYPES[kind])
        if not any(fits(k) for k in (kinds if isinstance(kinds, list) else [kinds])):
            return [f"{at}: type"]
    if value not in term("enum", list, [value]):
        out.append(f"{at}: enum")
    if isinstance(value, dict):
        props = term("properties", dict, {})
        out += [f"{at}.{k}: missing" for k in term("required", list, []) if isinstance(k, str) and k not in value]
        for k in sorted(value):
            if k in props:
                out += problems(value[k], props[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list):
        for i, x in enumerate(value):
            out += problems(x, schema.get("items"), f"{at}[{i}]")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < term("minimum", (int, float), value) or value > term("maximum", (int, float), value):
            out.append(f"{at}: range")
    elif isinstance(value, str):
        if not term("minLength", (int, float), 0) <= len(value) <= term("maxLength", (int, float), len(value)):
            out.append(f"{at}: length")
    return out


def _refers(value) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return [value["$result"]]
        return [r for v in value.values() for r in _refers(v)]
    return [r for v in value for r in _refers(v)] if isinstance(value, list) else []


def parse(conv: int | None, turn: int | None, role: str | None, text: str | None) -> list[tuple]:
    """Events of one row: (seq, kind, key, json, body, refers)."""
    out, rest, pos = [], [], 0
    for m in _TAG.finditer(text or "") if text and "<tool_" in text else ():
        v, kind = parsed(m[2]), m[1][5:]
        key = v.get("name" if kind == "schema" else "id") if isinstance(v, dict) else None
        if not isinstance(key, str) or kind == "call" and not isinstance(v.get("name"), str):
            continue
        rest.append(text[pos : m.start()])
        pos = m.end()
        refers = sorted(set(_refers(v.get("arguments")))) if kind == "call" else []
        key = _SURROGATE.sub("\ufffd", key)
        out.append((len(out) + 1, kind, key, canonical(v), canonical(v.get("arguments", {}) if kind == "call" else v.get("parameters", {}) if kind == "schema" else None), v.get("name") if kind == "call" else None, refers))
    content = text if text is None else "".join([*rest, text[pos:]])
    return [(0, "message", None, canonical({"content": content, "role": role, "turn": turn}), None, None, []), *out]


def format_chats(turns: DataFrame) -> DataFrame:
    """Events of (conv_id, turn, role, text): conv_id, turn, seq, kind, call_id,
    linked, problems, at_turn, at_level, json."""
    small_batches(turns.sparkSession)
    conv = turns.schema["conv_id"].dataType.simpleString()

    @releasing
    def run(batches):
        for batch in batches:
            rows = [(c, t, *e) for c, t, r, x in zip(*(col.to_pylist() for col in batch.columns)) for e in parse(c, t, r, x)]
            types = [batch.column(0).type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names=["conv_id", "turn", "seq", "kind", "key", "json", "body", "name", "refers"])

    scratch = Scratch(turns.sparkSession, "chat")
    events = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(run, f"conv_id {conv}, turn long, seq int, kind string, key string, json string, body string, name string, refers array<string>")
    events = scratch.put(events, "events")
    plain = events.where("kind = 'message'").select("conv_id", "turn", "seq", "kind", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("string").alias("problems"), F.col("turn").alias("at_turn"), F.lit(0).alias("at_level"), "json")
    # rows of one turn are told apart by what they say
    place = F.struct("turn", "seq", "json")
    first = lambda kind, *cols: events.where(F.col("kind") == kind).groupBy("conv_id", "key").agg(F.min_by(F.struct(*cols), place).alias("v")).select("conv_id", "key", "v.*")
    calls = first("call", F.col("turn").alias("c_turn"), F.col("seq").alias("c_seq"), F.sha2("json", 256).alias("c_hash"), "refers")
    results = first("result", F.col("turn").alias("r_turn"), F.col("seq").alias("r_seq"), F.sha2("json", 256).alias("r_hash"))
    schemas = events.where("kind = 'schema'").groupBy("conv_id", F.col("key").alias("name")).agg(F.max_by("body", place).alias("schema"))

    waits = calls.select("conv_id", "key", F.explode("refers").alias("on")).join(calls.select("conv_id", F.col("key").alias("on")), ["conv_id", "on"])
    at = _places(calls.select("conv_id", "key", F.col("c_turn").alias("turn")), waits, scratch)

    called = events.where("kind = 'call'").join(schemas, ["conv_id", "name"], "left")

    def validate(batches):
        for batch in batches:
            said = []
            for body, schema in zip(batch.column(batch.schema.get_field_index("body")).to_pylist(), batch.column(batch.schema.get_field_index("schema")).to_pylist()):
                said.append("no schema" if schema is None else "; ".join(problems(json.loads(body), json.loads(schema))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(said, pa.string())], names=["conv_id", "turn", "seq", "key", "json", "problems"])

    called = called.select("conv_id", "turn", "seq", "key", "json", "body", "schema").mapInArrow(validate, f"conv_id {conv}, turn long, seq int, key string, json string, problems string")
    own = called.join(calls.drop("refers"), ["conv_id", "key"], "left").join(results, ["conv_id", "key"], "left").join(at, ["conv_id", "key"], "left")
    counts = F.coalesce((F.col("turn") == F.col("c_turn")) & (F.col("seq") == F.col("c_seq")) & (F.sha2("json", 256) == F.col("c_hash")), F.lit(False))
    said = F.concat_ws("; ", F.when(F.col("problems") != "", F.col("problems")), F.when(~counts, F.lit("repeated identifier")), F.when(counts, F.col("stuck")))
    in_order = counts & F.col("stuck").isNull()
    call_rows = own.select("conv_id", "turn", "seq", F.lit("call").alias("kind"), F.col("key").alias("call_id"), (counts & F.col("r_turn").isNotNull()).alias("linked"), said.alias("problems"), F.when(in_order, F.col("at_turn")).otherwise(F.col("turn")).alias("at_turn"), F.when(in_order, F.col("at_level")).otherwise(0).alias("at_level"), "json")
    answers = events.where("kind = 'result'").select("conv_id", "turn", "seq", "key", "json").join(results, ["conv_id", "key"], "left").join(at, ["conv_id", "key"], "left")
    is_first = F.coalesce((F.col("turn") == F.col("r_turn")) & (F.col("seq") == F.col("r_seq")) & (F.sha2("json", 256) == F.col("r_hash")), F.lit(False))
    tied = is_first & F.col("at_turn").isNotNull()
    late = tied & (F.col("at_turn") >= F.col("turn"))
    result_rows = answers.select("conv_id", "turn", "seq", F.lit("result").alias("kind"), F.col("key").alias("call_id"), tied.alias("linked"), F.when(F.col("at_turn").isNull(), F.lit("no call")).when(~is_first, F.lit("repeated identifier")).otherwise("").alias("problems"), F.when(late, F.col("at_turn")).otherwise(F.col("turn")).alias("at_turn"), F.when(late, F.col("at_level") + 1).otherwise(0).alias("at_level"), "json")
    schema_rows = events.where("kind = 'schema'").select("conv_id", "turn", "seq", "kind", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("string").alias("problems"), F.col("turn").alias("at_turn"), F.lit(0).alias("at_level"), "json")
    return plain.unionByName(call_rows).unionByName(result_rows).unionByName(schema_rows)


def _places(calls: DataFrame, waits: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, key, stuck, at_turn, at_level) of calls (conv_id, key, turn), each
    after those that it waits for (conv_id, key, on).

    A round takes the calls that wait for nobody any more; the open rest is a
    written table that gets smaller each time."""
    who, free = ["conv_id", "key"], F.lit(None).cast("string").alias("stuck")
    open_ = scratch.put(waits.join(calls, who).select(*who, "on", "turn", F.lit(None).cast("struct<t:bigint,l:int>").alias("after")), "waits-0")
    done = [calls.join(open_, who, "left_anti").select(*who, free, F.col("turn").alias("at_turn"), F.lit(0).alias("at_level"))]
    ready, round_ = done[0], 0
    while open_.limit(1).count():
        told = ready.select("conv_id", F.col("key").alias("on"), F.struct(F.col("at_turn").cast("long").alias("t"), (F.col("at_level") + 2).alias("l")).alias("now"))
        known = open_.join(told, ["conv_id", "on"], "left").withColumn("after", F.coalesce("after", "now"))
        state = known.groupBy(*who).agg(F.bool_and(F.col("after").isNotNull()).alias("is_ready"), F.max("after").alias("last"), F.first("turn").alias("turn"))
        state = scratch.put(state.where("is_ready"), f"ready-{round_}")
        if not state.limit(1).count():
            break
        own = F.struct(F.col("turn").cast("long").alias("t"), F.lit(0).alias("l"))
        ready = state.select(*who, free, F.greatest(own, "last").alias("p")).select(*who, "stuck", F.col("p.t").alias("at_turn"), F.col("p.l").alias("at_level"))
        done.append(ready)
        open_ = scratch.put(known.drop("now").join(state, who, "left_anti"), f"waits-{round_ + 1}")
        round_ += 1
    # from the other end: those that nobody left waits for only wait for a cycle
    left, ring = open_.select(*who, "turn").distinct(), open_.where("after is null").select(*who, "on")
    while ring.limit(1).count():
        round_ += 1
        inner = ring.join(ring.select("conv_id", F.col("on").alias("key")).distinct(), who, "left_semi")
        n, ring = ring.count(), scratch.put(inner, f"ring-{round_}")
        if ring.count() == n:
            break
    in_ring = ring.select(*who).distinct().withColumn("stuck", F.lit("cycle"))
    stuck = left.join(in_ring, who, "left").select(*who, F.coalesce("stuck", F.lit("waits for a cycle")).alias("stuck"), F.col("turn").alias("at_turn"), F.lit(0).alias("at_level"))
    # few rows a round: one table, so that a long chain makes no plan of many branches
    out = scratch.path("places")
    for i in range(0, len(done), 50):
        part = done[i]
        for more in done[i + 1 : i + 50]:
            part = part.unionByName(more)
        part.write.mode("append").parquet(out)
    stuck.write.mode("append").parquet(out)
    return calls.sparkSession.read.schema(stuck.schema).parquet(out)


#: For conversations without tagged parts, as those of the fixture tables are.
ORACLE = """
SELECT conv_id, turn, CAST(0 AS INTEGER) AS seq, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id,
  CAST(NULL AS BOOLEAN) AS linked, CAST(NULL AS VARCHAR) AS problems, turn AS at_turn, CAST(0 AS INTEGER) AS at_level,
  '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null')
    || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '}' AS json
FROM conversations
"""
