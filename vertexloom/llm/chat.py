"""Chat formatting with tool-call linking.

A turn's text is a plain message, or JSON: {"tool_calls": [{"id", "name",
"arguments"}]} of an assistant, {"tool_call_id", "content"} of a tool. Calls
and results of a conversation are hash-joined by identifier. A call may use
another's result by {"$ref": id} anywhere in its arguments; depth orders calls
after what they refer to. Arguments are checked against the tool's schema, and
each message is serialised as canonical JSON: keys sorted, no spaces.

Rows stay one a message or call: sorting a conversation by (anchor_turn, depth,
turn, item) gives its order, so no task ever gathers a whole conversation.

Defined results: null or unreadable text is an ordinary message with that text,
and so is JSON that holds NaN or an infinity, or nests too deeply to be worked
on; lone surrogates are written as escapes; of several calls with one id the
first by (turn, item) is linked, the others are "duplicate"; a result without
call is "orphan", a call without result "open"; calls in a circle of
references, or on the way from one circle to another, have the status
"circular", those that merely wait for one don't; a null conv_id links nothing.
Repeated rows are turns each, of which the calls are duplicates. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.llm.shared import stored, table

#: Argument schemas of the registered query: JSON Schema's type, properties, required, enum and items.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


LONE = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """text with lone surrogates, which no column can hold, as JSON escapes."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return escaped(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What of value breaks the schema; a reference stands for any value."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kind = schema.get("type")
    if kind in TYPES and (not isinstance(value, TYPES[kind]) or kind != "boolean" and isinstance(value, bool)):
        return [f"{at}: not of type {kind}"]
    out = [f"{at}: not one of the values"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        out += [f"{at}: lacks {k}" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in schema.get("properties", {}):
                out += problems(v, schema["properties"][k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}: has {k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += problems(v, schema["items"], f"{at}[{i}]")
    return out


def references(value) -> list[str]:
    if isinstance(value, dict):
        return [value["$ref"]] if isinstance(value.get("$ref"), str) and len(value) == 1 else [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def read_turn(role: str | None, text: str | None, schemas: dict) -> list[tuple]:
    """(kind, call_id, refs, error, json) of what a turn holds."""
    plain = [("message", None, [], None, canonical({"content": text, "role": role}))]
    if not text or text.lstrip()[:1] != "{":
        return plain
    try:
        return read_json(role, json.loads(text, parse_constant=no_number), schemas) or plain
    except (ValueError, RecursionError):
        return plain


def read_json(role: str | None, got: dict, schemas: dict) -> list[tuple]:
    """What a turn that is a JSON object holds; nothing if it is neither calls nor a result."""
    if role == "tool" and isinstance(got.get("tool_call_id"), str):
        return [("result", escaped(got["tool_call_id"]), [], None, canonical({"content": got.get("content"), "role": role, "tool_call_id": got["tool_call_id"]}))]
    if role != "assistant" or not isinstance(got.get("tool_calls"), list):
        return []
    out = [("message", None, [], None, canonical({"content": got["content"], "role": role}))] if got.get("content") is not None else []
    for call in got["tool_calls"]:
        if not isinstance(call, dict):
            out.append(("call", None, [], "not an object", canonical(call)))
            continue
        args, error = call.get("arguments"), None
        if isinstance(args, str):
            try:
                args = json.loads(args, parse_constant=no_number)
            except (ValueError, RecursionError):
                error = "arguments: not JSON"
        if not error:
            known = isinstance(call.get("name"), str) and call["name"] in schemas
            error = escaped("; ".join(problems(args, schemas[call["name"]]))) or None if known else "unknown tool"
        call_id = escaped(call["id"]) if isinstance(call.get("id"), str) else None
        out.append(("call", call_id, [escaped(r) for r in references(args)], error, canonical({"arguments": args, "id": call.get("id"), "name": call.get("name"), "role": role})))
    return out


def format_chats(turns: DataFrame, schemas: dict | None = None) -> DataFrame:
    """(conv_id, turn, item, kind, call_id, status, error, anchor_turn, depth, json), a row for each message, call and result."""
    schemas = schemas or {}
    kinds = [turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for k, (role, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for item, row in enumerate(read_turn(role, text, schemas)):
                    owner.append(k)
                    rows.append((item, *row))
            own = pa.array(owner, pa.int64())
            cols = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c, t) for c, t in zip(cols, types))], ["conv_id", "turn", "item", "kind", "call_id", "refs", "error", "json"])

    all_ = stored(turns.select("conv_id", "turn", "role", "text").mapInArrow(read, f"conv_id {kinds[0]}, turn {kinds[1]}, item int, kind string, call_id string, refs array<string>, error string, json string"))
    first = Window.partitionBy("conv_id", "call_id").orderBy("turn", "item")
    calls = all_.where("kind = 'call' AND call_id IS NOT NULL AND conv_id IS NOT NULL").withColumn("nth", F.row_number().over(first))
    calls = stored(calls.where("nth = 1").select("conv_id", "call_id", F.col("turn").alias("call_turn"), F.col("item").alias("call_item"), "refs"))
    depth = stored(calls.select("conv_id", "call_id", F.lit(0).alias("depth")))
    refs = calls.select("conv_id", "call_id", F.explode("refs").alias("ref")).join(calls.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"])
    refs = stored(refs)
    todo, level = refs.select("conv_id", "call_id").distinct(), 0
    while not todo.isEmpty():  # calls that wait for one found at the level before; they get fewer or repeat, so this ends
        level += 1
        depth = stored(depth.join(todo.withColumn("up", F.lit(level)), ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("up", "depth").alias("depth")))
        next_ = stored(refs.join(todo.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"]).select("conv_id", "call_id").distinct())
        if next_.count() == todo.count() and next_.exceptAll(todo).isEmpty():  # what is left is in a circle or waits for one
            inner, n = next_, -1
            while n != (n := inner.count()):  # calls that no other of these refers to go
                used = refs.join(inner, ["conv_id", "call_id"]).select("conv_id", F.col("ref").alias("call_id")).distinct()
                inner = stored(inner.join(used, ["conv_id", "call_id"], "left_semi"))
            next_ = inner
            depth = stored(depth.join(next_.withColumn("loop", F.lit(-1)), ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("loop", "depth").alias("depth")))
            break
        todo = next_
    answered = all_.where("kind = 'result'").select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    known = calls.drop("refs").join(depth, ["conv_id", "call_id"]).join(answered, ["conv_id", "call_id"], "left")
    out = all_.join(known, ["conv_id", "call_id"], "left")
    own = (F.col("call_turn") == F.col("turn")) & (F.col("call_item") == F.col("item"))
    status = (
        F.when(F.col("kind") == "message", "message")
        .when(F.col("kind") == "result", F.when(F.col("call_turn").isNotNull(), "linked").otherwise("orphan"))
        .when(F.col("call_turn").isNull(), "open").when(~own, "duplicate").when(F.col("depth") < 0, "circular").when(F.col("answered"), "linked").otherwise("open"))
    placed = F.when(F.col("kind") == "message", F.lit(0)).otherwise(2 * F.greatest(F.coalesce("depth", F.lit(0)), F.lit(0)) + (F.col("kind") == "result").cast("int") + 1)
    anchor = F.when((F.col("kind") == "result") & F.col("call_turn").isNotNull(), F.col("call_turn")).otherwise(F.col("turn"))
    return out.select("conv_id", "turn", "item", "kind", "call_id", status.alias("status"), "error", anchor.alias("anchor_turn"), placed.cast("int").alias("depth"), "json")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"), SCHEMAS)


# No turn of the given tables is JSON, so all are messages; tests hold calls and results against brute force.
OP3_SQL = """
SELECT conv_id, turn, CAST(0 AS INTEGER) AS item, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, 'message' AS status, CAST(NULL AS VARCHAR) AS error, turn AS anchor_turn, CAST(0 AS INTEGER) AS depth,
       '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' AS json FROM conversations
"""
