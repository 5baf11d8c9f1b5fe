"""Column functions on file paths and names."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


def extension(path: Column) -> Column:
    """Lower case, without the dot; of a dotfile its name; empty where the last dot stands before the last separator."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def dotted_extension(path: Column) -> Column:
    """With the dot, as found; empty for a dotfile or a name without a dot."""
    return F.regexp_extract(base_name(path), r"(?s)^.+?(\.[^.]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def file_name(path: Column) -> Column:
    """After the last separator of either kind, lower case."""
    return F.lower(F.element_at(F.split(path, r"[/\\]", -1), -1))


def has_keyword(name: Column, keyword: str) -> Column:
    """The first occurrence of the keyword stands alone: no letter or digit on either side of it."""
    at = F.instr(name, keyword)
    left, right = F.substring(name, at - 1, F.lit(1)), F.substring(name, at + len(keyword), F.lit(1))
    return (at > 0) & ((at == 1) | ~F.regexp_like(left, F.lit("[a-z0-9]"))) & ~F.regexp_like(right, F.lit("[a-z0-9]"))


def keywords(name: Column, words: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*(F.when(has_keyword(name, w), w) for w in words)))


def filter_result(path: Column) -> Column:
    """struct(type, ambiguous, ext, keywords): structured by extension, then by name; ambiguous; or undecided."""
    ext, words = extension(path), keywords(file_name(path), P.FILTER_KEYWORDS)
    by_ext = F.coalesce(ext.isin(*P.STRUCTURED_EXTENSIONS), F.lit(False))
    by_name = F.coalesce(~by_ext & (F.size(words) > 0), F.lit(False))
    return F.struct(
        F.when(by_ext | by_name, "structured").alias("type"),
        F.coalesce(~by_ext & ~by_name & ext.isin(*P.AMBIGUOUS_EXTENSIONS), F.lit(False)).alias("ambiguous"),
        F.coalesce(ext, F.lit("")).alias("ext"),
        F.when(by_name, words).otherwise(F.array().cast("array<string>")).alias("keywords"),
    )


def language(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in P.LANGUAGES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def language_of_source(source: Column) -> Column:
    """By what follows the last dot anywhere in the path."""
    return language(F.lower(F.regexp_extract(source, r"(?s)\.([^.]*)$", 1)))


def import_candidates(importer: str | None, source: str | None) -> list[str]:
    """The paths that a relative import may mean, best first; none for a package."""
    if not importer or not source or not source.startswith("."):
        return []
    base = posixpath.normpath(posixpath.join(posixpath.dirname(importer), source))
    return list(dict.fromkeys([base, *(base + e for e in P.IMPORT_EXTENSIONS), *(posixpath.join(base, "index") + e for e in P.IMPORT_EXTENSIONS)]))


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def import_candidates_column(importer: str | None, source: str | None) -> list[str]:
    """Path normalisation has no built-in form; imports are few beside lines of code."""
    return import_candidates(importer, source)
