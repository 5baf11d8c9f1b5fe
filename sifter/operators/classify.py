"""Content classification: structured, prose, mixed or empty, with a confidence and the signals behind it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import paths
from ..functions.text import binary, blank, count, found, lines, staged, symbol_ratio, trim, units


def _no_constant(name: str) -> None:
    raise ValueError(name)


@F.udf(T.BooleanType(), useArrow=True)
def _strict_json(text: str | None) -> bool:
    try:
        return isinstance(json.loads(text or "", parse_constant=_no_constant), (dict, list))
    except (ValueError, RecursionError):
        return False


def json_valid(text: Column) -> Column:
    """Strict JSON whose value is an object or a list. Only texts that begin and end like one reach the Python parser."""
    body = F.when(F.regexp_like(text, F.lit(P.jvm(r"^{W}*+[\[{]"))), trim(text))
    like = F.regexp_like(body, F.lit(r"(?s)^(\{.*\}|\[.*\])$"))
    return F.coalesce(_strict_json(F.when(like, body)), F.lit(False)) & F.coalesce(like, F.lit(False))


def line_structured(text: Column) -> Column:
    """Over half of the first 50 plain lines repeat the first 6 characters of another."""
    kept = F.filter(lines(text), lambda x: F.regexp_like(x, F.lit(P.jvm(P.PLAIN_LINE))))
    heads = F.transform(F.slice(kept, 1, 50), lambda x: F.substring(x, 1, 6))
    return (F.size(kept) > 5) & (1 - F.size(F.array_distinct(heads)) / F.size(heads) > 0.5)


def prose_ratio(text: Column, size: Column | None = None) -> Column:
    """Prose markers in 100 units of text."""
    return count(text, P.PROSE) / F.greatest(F.lit(1.0), (units(text) if size is None else size) / 100)


def prose_run(text: Column) -> Column:
    """The longest run of lines with two strong prose markers each; blank lines don't break it. Lines are only looked at where the
    whole text has a marker: without one there is no run."""
    marked = F.transform(F.filter(lines(text), lambda x: ~blank(x)), lambda x: F.regexp_count(x, F.lit(P.STRONG_PROSE)) >= 2)
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, hit: Column) -> Column:
        run = F.when(hit, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    run = F.aggregate(marked, start, step, lambda acc: acc["most"])
    return F.when(F.regexp_like(text, F.lit(P.STRONG_PROSE)), run).when(text.isNotNull(), 0)


def tag_density(text: Column, size: Column | None = None) -> Column:
    return F.when(F.contains(text, F.lit("<")), count(text, P.TAG)).otherwise(0) / F.greatest(F.lit(1.0), (units(text) if size is None else size) / 100)


def with_class(df: DataFrame, out: str, text: str = "text", tool: str = "tool", path: str = "path") -> DataFrame:
    """Adds ``out``: struct(type, confidence, signals). A null text is empty; tool and path columns may be missing.

    Every step is a column of its own, so no pattern runs twice; the cheap gates (empty, binary, path) come first and texts that
    they decide are not searched for signals.
    """
    optional = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    t, ratio, names, size = F.col("_c_text"), F.col("_c_ratio"), F.col("_c_names"), F.col("_c_size")
    open_ = F.col("_c_gate") == ""
    df = staged(df, _c_text=F.coalesce(F.col(text), F.lit("")), _c_tool=optional(tool), _c_path=paths.filter_result(optional(path)))
    df = staged(df, _c_gate=F.when(F.length(t) == 0, "empty").when(binary(t), "binary").when(F.col("_c_path.type") == "structured", "path").otherwise(""), _c_size=units(t))
    df = df.withColumn("_c_json", json_valid(F.when(open_, t)))
    df = staged(df, _c_ratio=F.when(open_, prose_ratio(t, size)))
    tests = [
        (open_ & F.col("_c_json"), F.lit("json-valid")),
        (open_ & (symbol_ratio(t, size) > P.SYMBOL_RATIO), F.lit("strong-symbol")),
        (open_ & (tag_density(t, size) > 1), F.lit("markup-tag")),
        (open_ & found(t, P.ANSI), F.lit("ansi")),
        (open_ & line_structured(t), F.lit("line-structured")),
        (ratio > 1.5, F.lit("prose-heavy")),
        (open_ & (prose_run(t) >= 3), F.lit("prose-lines")),
        (open_ & F.col("_c_tool").isin(*P.SIGNAL_TOOLS), F.concat(F.lit("tool:"), F.col("_c_tool"))),
    ]
    df = staged(df, _c_names=F.array_compact(F.array(*(F.when(test, name) for test, name in tests))))
    has = lambda name: F.array_contains(names, name)
    score = F.when(has("json-valid"), 2.0).otherwise(0.0)
    for name in ("strong-symbol", "markup-tag", "ansi", "line-structured"):
        score = score + F.when(has(name), 1.5).otherwise(0.0)
    df = staged(df, _c_s=score, _c_p=F.when(ratio > 1.5, 0.6 + (ratio - 1.5) * 0.8).otherwise(0.0), _c_prose=has("prose-heavy") | has("prose-lines"))
    s, p, prose, gate, by_path = F.col("_c_s"), F.col("_c_p"), F.col("_c_prose"), F.col("_c_gate"), F.col("_c_path")
    kind = (
        F.when(gate == "empty", "empty").when(gate != "", "structured").when(prose & (s >= 1.5), "mixed").when(prose, "prose").when(s >= 1.5, "structured").otherwise("prose")
    )
    sure = (
        F.when(gate == "empty", 1.0).when(gate == "binary", 0.95).when(gate == "path", 0.9).when(prose & (s >= 2.5), 0.7).when(prose & (s >= 1.5), 0.6)
        .when(prose & (p > 0), F.least(F.lit(1.0), 0.6 + (p - 0.6) * 0.2)).when(prose, 0.55).when(s >= 2, F.least(F.lit(1.0), s / 3)).otherwise(0.5)
    )
    why = F.when(F.size(by_path["keywords"]) > 0, F.concat(F.lit("name:"), F.get(by_path["keywords"], 0))).otherwise(F.concat(F.lit("ext:"), by_path["ext"]))
    shown = F.when(gate == "path", F.array(why)).when(gate != "", F.array(gate)).otherwise(names)
    df = staged(df.drop(out), **{out: F.struct(kind.alias("type"), sure.alias("confidence"), shown.alias("signals"))})
    return df.drop("_c_text", "_c_tool", "_c_path", "_c_gate", "_c_size", "_c_json", "_c_ratio", "_c_names", "_c_s", "_c_p", "_c_prose")
