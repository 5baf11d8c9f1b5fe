"""Column functions on text. Lengths are UTF-16 units; prefixes are cut by characters, which differs beyond the basic plane only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .patterns import jvm


def staged(df: DataFrame, **values: Column) -> DataFrame:
    """Steps of a longer computation as columns of their own. They pass through a generator of one row, which no rule of the optimizer
    looks behind: filters, joins and projections above read the value and never get a copy of the expression. The names must be new."""
    made = df.withColumn("_staged", F.explode(F.array(F.struct(*(v.alias(k) for k, v in values.items())))))
    return made.select(*df.columns, *(F.col(f"_staged.{k}").alias(k) for k in values))


def units(text: Column) -> Column:
    """Length in UTF-16 units; of ASCII text its length in bytes."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(jvm(pattern)))


def found(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(jvm(pattern)))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, jvm("^{W}+|{W}+$"), "")


def trim_start(text: Column) -> Column:
    return F.regexp_replace(text, jvm("^{W}+"), "")


def blank(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(jvm("{N}")))


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, P.ANSI, "")


def normalised(text: Column) -> Column:
    """For comparison: no terminal codes, one space for any white space, trimmed."""
    return trim(F.regexp_replace(without_ansi(text), jvm("{W}+"), " "))


def with_strip(df: DataFrame, out: str, text: str = "text", minimum: int = P.STRIP_MIN, ansi: bool = True, inline: bool = True, trailing: bool = True) -> DataFrame:
    """Adds ``out``: struct(text, method); terminal codes, runs of inline white space and trailing spaces are removed. A step
    counts in the method when it changed the length, so replacing a tab by a space goes unnamed."""
    t, a, b, c = F.col(text), F.col("_f1"), F.col("_f2"), F.col("_f3")
    df = staged(df, _f1=without_ansi(t) if ansi else t)
    df = staged(df, _f2=F.regexp_replace(a, P.INLINE_SPACE, " ") if inline else a)
    df = staged(df, _f3=F.regexp_replace(b, "(?md) +$", "") if trailing else b)
    changed = lambda x, y, name: F.when(F.length(x) != F.length(y), name)
    df = staged(df, _f4=F.concat_ws("+", changed(t, a, "ansi"), changed(a, b, "inline-ws"), changed(b, c, "trailing-ws")), _f5=units(t) < minimum)
    method = F.concat(F.lit("format-strip:"), F.when(F.col("_f4") == "", "noop").otherwise(F.col("_f4")))
    short = F.col("_f5")
    done = F.struct(F.when(short, t).otherwise(c).alias("text"), F.when(short, "format-strip:noop").otherwise(method).alias("method"))
    return staged(df.drop(out), **{out: done}).drop("_f1", "_f2", "_f3", "_f4", "_f5")


def format_restore(text: Column) -> Column:
    """What undoes a format strip: nothing, as texts need only be equal but for white space and terminal codes."""
    return text


def handle(prefix: str, content: Column) -> Column:
    """A handle made from the content, so that retries and replays give the same one."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(content, 256), 1, 12))


def original_handle(number: Column) -> Column:
    return F.concat(F.lit("orig-"), F.lower(F.conv(number, 10, 36)))


def line_range(text: Column, start: Column, number: Column) -> Column:
    """Lines from ``start`` (1-based, clamped) on; empty beyond the end."""
    parts, first = lines(text), F.greatest(start, F.lit(1))
    return F.when((first > F.size(parts)) | (number <= 0), F.lit("")).otherwise(F.array_join(F.slice(parts, first, number), "\n"))


def signature(declaration: Column) -> Column:
    """What stands before the first brace or arrow; else the first line."""
    brace, arrow = F.instr(declaration, "{"), F.instr(declaration, "=>")
    cut = F.when((brace > 0) & ((arrow == 0) | (brace < arrow)), brace).otherwise(arrow)
    head = F.regexp_replace(trim(F.substring(declaration, F.lit(1), cut - 1)), jvm("[{C};]+$"), "")
    return F.when(cut > 1, head).otherwise(trim(F.element_at(lines(declaration), 1)))


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)^([\"'`])(.*)\\1$", "$2")


def binary(text: Column) -> Column:
    """A NUL anywhere, or over a tenth of the first 2048 characters are control characters."""
    head = F.substring(text, 1, 2048)
    return (F.instr(text, "\0") > 0) | (F.regexp_count(head, F.lit(P.CONTROL_CLASSIFIER)) > 0.1 * F.length(head))


def binary_for_digest(text: Column) -> Column:
    """Control characters are over a twentieth of the first 20,000 characters, or of any prefix beyond 2,001 of them. The running
    share only matters when the whole has any, so the scan is skipped for clean text."""
    head = F.substring(text, 1, 20000)
    bad = F.regexp_count(head, F.lit(P.CONTROL_DIGEST))
    zero = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("bad"), F.lit(False).alias("hit"))

    def step(acc: Column, c: Column) -> Column:
        more = acc["bad"] + F.when(F.regexp_like(c, F.lit(P.CONTROL_DIGEST)), 1).otherwise(0)
        return F.struct((acc["seen"] + 1).alias("seen"), more.alias("bad"), (acc["hit"] | ((acc["seen"] > 2000) & (more > 0.05 * (acc["seen"] + 1)))).alias("hit"))

    running = F.aggregate(F.split(head, ""), zero, step, lambda acc: acc["hit"])
    return F.when(bad > 0.05 * F.length(head), True).when(bad > 100, running).otherwise(False)


def symbol_ratio(text: Column, size: Column | None = None) -> Column:
    size = units(text) if size is None else size
    bare = F.replace(F.replace(F.replace(text, F.lit("{")), F.lit("}")), F.lit(";"))  # cheaper than a pattern or a translation
    marks = F.length(text) - F.length(bare)
    return F.when(size > 0, marks / size).otherwise(F.lit(0.0))


def markup(text: Column) -> Column:
    return F.regexp_count(F.substring(text, 1, 100000), F.lit(P.TAG_START)) > P.MAX_TAGS


def rounded(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """One decimal; NULL where the whole is zero."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), 1)
