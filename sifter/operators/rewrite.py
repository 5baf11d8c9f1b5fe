"""Tool events: every long string leaf of a response is classified, compressed where structured, and put back in place."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.paths import extension, language
from ..functions.text import handle, lines, units
from .classify import with_class
from .compress import note, with_compression

_LEAF = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("text", T.StringType())])
_EVENT = T.StructType([*(T.StructField(n, T.StringType()) for n in ("tool", "path", "session_id")), T.StructField("leaves", T.ArrayType(_LEAF))])


def _get(event: dict, *names: str):
    return next((event[n] for n in names if event.get(n) is not None), None)


def _strings(node, out: list[str]) -> None:
    if isinstance(node, str):
        out.append(node)
    elif isinstance(node, list):
        for x in node:
            _strings(x, out)
    elif isinstance(node, dict):
        for x in node.values():
            _strings(x, out)


@F.udf(_EVENT, useArrow=True)
def parse_event(value: str | None) -> dict | None:
    """tool, path, session and string leaves of a hook event; NULL where it isn't a JSON object with a response."""
    try:
        event = json.loads(value or "")
    except (ValueError, RecursionError):
        return None
    response = _get(event, "tool_response", "toolResponse") if isinstance(event, dict) else None
    if response is None:
        return None
    inner = _get(event, "tool_input", "toolInput")
    path = inner.get("file_path") if isinstance(inner, dict) else None
    leaves: list[str] = []
    _strings(response, leaves)
    return {"tool": _get(event, "tool_name", "toolName"), "path": path if isinstance(path, str) else None, "session_id": _get(event, "session_id"), "leaves": [{"at": i, "text": t} for i, t in enumerate(leaves)]}


@F.udf(T.StringType(), useArrow=True)
def _put_back(value: str, places: list[int], texts: list[str]) -> str:
    """The response of an event as JSON of the same shape, with some string leaves replaced."""
    new, n = dict(zip(places, texts, strict=True)), iter(range(1 << 62))

    def walk(node):
        if isinstance(node, str):
            return new.get(next(n), node)
        if isinstance(node, list):
            return [walk(x) for x in node]
        return {k: walk(x) for k, x in node.items()} if isinstance(node, dict) else node

    return json.dumps(walk(_get(json.loads(value), "tool_response", "toolResponse")), ensure_ascii=False)


def leaves(events: DataFrame) -> DataFrame:
    """events(event_id, value): one row per string leaf of a watched tool's response."""
    rows = events.select("event_id", parse_event("value").alias("e")).where(F.col("e.tool").isin(*P.HOOK_TOOLS))
    return rows.select("event_id", "e.tool", "e.path", "e.session_id", F.explode("e.leaves").alias("l")).select("event_id", "tool", "path", "session_id", "l.at", "l.text")


def compressed_leaves(events: DataFrame, minimum: int = P.HOOK_MIN) -> DataFrame:
    """The long structured leaves with their compression. Prose, mixed and short leaves don't appear, so they stay as they are."""
    long = leaves(events).where(units(F.col("text")) >= minimum)
    kept = with_compression(with_class(long, "result").where("result.type = 'structured'"), "text", "c").where("c.compressed")
    name = handle("orig", F.col("text"))
    code = language(extension(F.col("path"))).isNotNull()
    emitted = F.concat(F.col("c.text"), note(name, F.size(lines(F.col("text"))), F.col("path"), F.coalesce(code, F.lit(False))))
    return kept.withColumn("handle", name).withColumn("emitted", emitted)


def rewritten(events: DataFrame, minimum: int = P.HOOK_MIN, rows: DataFrame | None = None) -> DataFrame:
    """event_id and output of the events that change: the hook's answer with the new response. rows: their compressed leaves, where a
    caller has them already."""
    new = (compressed_leaves(events, minimum) if rows is None else rows).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("at", "emitted"))).alias("n"))
    joined = events.join(new, "event_id")
    response = _put_back("value", F.col("n.at"), F.col("n.emitted"))
    out = F.concat(F.lit('{"hookSpecificOutput":{"hookEventName":"PostToolUse","updatedToolOutput":'), response, F.lit("}}"))
    return joined.select("event_id", out.alias("output"))


def tables(events: DataFrame, now_ms: int, minimum: int = P.HOOK_MIN, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """What ingestion stores: originals and snippets (so that every handle in an emitted text resolves) and metric rows. Rows of one
    handle are one row when their contents are equal too; texts that share a handle by chance are both kept."""
    rows = compressed_leaves(events, minimum) if rows is None else rows
    base = rows.select("handle", F.col("text").alias("content"), F.lit(False).alias("compressed"), units(F.col("text")).cast("long").alias("size"), F.col("path").alias("source"), "tool", F.lit(now_ms).alias("created_at"))
    cut = rows.select(F.explode("c.snippets").alias("s"), "path", "tool").select(
        "s.handle", "s.content", F.lit(False).alias("compressed"), units(F.col("s.content")).cast("long").alias("size"), F.col("path").alias("source"), "tool", F.lit(now_ms).alias("created_at")
    )
    metric = rows.select(
        "handle", F.col("path").alias("source"), "tool", F.col("result.type").alias("content_type"), F.col("c.original_size").cast("long").alias("original_size"), F.col("c.compressed_size").cast("long").alias("compressed_size"),
        F.concat_ws(",", "c.steps").alias("method"), "session_id", F.lit(now_ms).alias("created_at"),
    )
    return {"originals": base.unionByName(cut).withColumn("_same", F.sha2("content", 256)).dropDuplicates(["handle", "_same"]).drop("_same"), "metrics": metric}
