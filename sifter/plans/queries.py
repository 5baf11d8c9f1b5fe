"""Registered queries of the library's own operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import paths, text
from ..operators import classify as C
from ..operators import codegraph, corpus, diagnosis, metrics, search, store
from ..operators import compress as Z
from . import captures as S
from . import duck as D
from .captures import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def rows(spark: SparkSession, columns: str, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, columns)


def values_sql(columns: list[str], values: list[tuple]) -> str:
    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return D.text(v).replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") if isinstance(v, str) else str(v)

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, v)) + ")" for v in values) + ") AS t(" + ", ".join(columns) + "))"


# Captures as metric rows: classified, and stripped where structured -------------------------------------------------------------

def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored metric rows that the reports read: a row per capture. One in eleven has the retired method and one in thirteen none;
    retrievals are every third row."""
    return S.once(spark, sf_dir, "metrics", _metric_rows)


def _metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = text.with_strip(C.with_class(S.captures(spark, sf_dir), "r"), "s")
    stripped = F.col("s")
    structured = F.col("r.type") == "structured"
    method = F.when(F.col("seq") % 11 == 3, "format-strip+dedup").when(F.col("seq") % 13 == 5, F.lit(None)).when(structured, stripped["method"]).otherwise("none")
    return rows_.select(
        F.col("seq").alias("id"), F.col("key").alias("handle"), F.col("path").alias("source"), "tool", F.col("r.type").alias("content_type"), text.units(F.col("text")).cast("long").alias("original_size"),
        F.when(structured, text.units(stripped["text"])).otherwise(text.units(F.col("text"))).cast("long").alias("compressed_size"), method.alias("method"), F.lit(0).cast("long").alias("retrieved_count"),
        F.col("session").alias("session_id"), (F.col("seq") * 1000 + F.length("key")).cast("long").alias("created_at"),
    )


_METRICS_SQL = f"""(SELECT seq AS id, key AS handle, path AS source, tool, type AS content_type, {D.units('text0')} AS original_size, CASE WHEN type = 'structured' THEN {D.units('text1')} ELSE {D.units('text0')} END AS compressed_size,
  CASE WHEN seq % 11 = 3 THEN 'format-strip+dedup' WHEN seq % 13 = 5 THEN NULL WHEN type = 'structured' THEN method ELSE 'none' END AS method, session AS session_id, CAST(seq * 1000 + length(key) AS BIGINT) AS created_at, CASE WHEN seq % 3 = 0 THEN 2 ELSE 0 END AS retrieved_count
  FROM {D.strip_cte(D.classified(S.CAPTURES_SQL), 'key, path, tool, session, seq, type')})"""


def _retrievals(metric_rows: DataFrame) -> DataFrame:
    """Two retrievals of the handle of every third row."""
    return metric_rows.where("id % 3 = 0").select("handle", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select("handle")


_COUNTED = "method NOT ILIKE '%dedup%'"


@query(f"SELECT content_type, count(*) AS n, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum(original_size - compressed_size) AS BIGINT) AS saved FROM {_METRICS_SQL} GROUP BY content_type")
def m0_saved_by_type(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.groupBy("content_type").agg(F.count("*").alias("n"), F.sum("original_size").alias("original"), F.sum(F.col("original_size") - F.col("compressed_size")).alias("saved"))


@query(f"SELECT doc_id, {D.units('text1')} AS size, method, md5(text1) AS digest FROM {D.strip_cte(f'({S.NOISY_SQL})', 'doc_id')}")
def p01_format_strip(spark, sf_dir):
    out = text.with_strip(S.noisy(spark, sf_dir), "s")
    return out.select("doc_id", text.units(F.col("s.text")).alias("size"), "s.method", F.md5("s.text").alias("digest"))


@query(f"SELECT doc_id, regexp_matches(text, {D.rx(P.ANSI)}) AS has_ansi, len(regexp_extract_all(text, {D.rx(P.ANSI)})) AS codes FROM ({S.NOISY_SQL})")
def p02_ansi(spark, sf_dir):
    return S.noisy(spark, sf_dir).select("doc_id", text.found(F.col("text"), P.ANSI).alias("has_ansi"), text.count(F.col("text"), P.ANSI).cast("long").alias("codes"))


_NORMAL = D.trim(f"regexp_replace(regexp_replace(text, {D.rx(P.ANSI)}, '', 'g'), {D.rx('{W}+')}, ' ', 'g')")


@query(f"SELECT doc_id, md5({_NORMAL}) AS digest FROM ({S.NOISY_SQL})")
def p03_normalize(spark, sf_dir):
    return S.noisy(spark, sf_dir).select("doc_id", F.md5(text.normalised(F.col("text"))).alias("digest"))


_SNIP = D.snip_parts("text")


@query(f"SELECT key, CASE WHEN {_SNIP['cut']} THEN {_SNIP['name']} END AS handle, {D.units('CASE WHEN ' + _SNIP['cut'] + ' THEN ' + _SNIP['kept'] + ' ELSE text END')} AS size, CASE WHEN {_SNIP['cut']} THEN md5({_SNIP['middle']}) END AS middle, CASE WHEN {_SNIP['cut']} THEN 31 END AS start_line, CASE WHEN {_SNIP['cut']} THEN {_SNIP['total']} - 30 END AS end_line FROM ({S.LONG_SQL})")
def p05_snip(spark, sf_dir):
    out = Z.with_snip(S.long_texts(spark, sf_dir), "s")
    return out.select("key", "s.handle", text.units(F.col("s.text")).cast("long").alias("size"), F.md5("s.content").alias("middle"), F.col("s.start_line").cast("int").alias("start_line"), F.col("s.end_line").cast("long").alias("end_line"))


@query(f"SELECT key, md5(text) AS digest, CAST(NULL AS VARCHAR) AS warning FROM ({S.LONG_SQL}) WHERE {_SNIP['cut']}")
def p06_snip_restore(spark, sf_dir):
    out = Z.with_snip(S.long_texts(spark, sf_dir), "s").where("s.handle IS NOT NULL").select("key", "s.*")
    back = Z.snip_restore(out.select("handle", "text"), out.select("handle", "content"))
    return out.select("key", "handle").join(back, "handle").select("key", F.md5("text").alias("digest"), "warning")


@query(f"SELECT key, start, CASE WHEN start > len({D.lines('text')}) THEN '' ELSE array_to_string(({D.lines('text')})[greatest(start, 1):greatest(start, 1) + 4], chr(10)) END AS part FROM ({S.LONG_SQL}), (VALUES (-3), (1), (10), (100000000)) AS v(start)")
def p11_get_lines(spark, sf_dir):
    out = S.long_texts(spark, sf_dir).withColumn("start", F.explode(F.array(*map(F.lit, (-3, 1, 10, 100000000)))))
    return out.select("key", "start", text.line_range(F.col("text"), F.col("start"), F.lit(5)).alias("part"))


_DECLARATIONS = [
    ("function add(a, b) { return a + b; }",), ("const twice = (x) => x * 2;",), ("class Box extends Base {\n  size = 1;\n}",), ("export const f = async (a: {x: number}) => a",), ("let plain = 3;\nlet other = 4;",), ("{ bare }",), ("  run(items: string[]): Promise<void> ; {",),
]


@query(
    f"""SELECT text, CASE WHEN cut > 1 THEN regexp_replace({D.trim('substr(text, 1, cut - 1)')}, {D.rx('[{C};]+$')}, '') ELSE {D.trim("string_split(text, chr(10))[1]")} END AS signature FROM (SELECT text, CASE WHEN instr(text, '{{') > 0 AND (instr(text, '=>') = 0 OR instr(text, '{{') < instr(text, '=>')) THEN instr(text, '{{') ELSE instr(text, '=>') END AS cut FROM {values_sql(["text"], _DECLARATIONS)})"""
)
def p12_signature(spark, sf_dir):
    return rows(spark, "text STRING", _DECLARATIONS).select("text", text.signature(F.col("text")).alias("signature"))


_QUOTED = [("'a'",), ('"b c"',), ("`d`",), ("'",), ("\"x'",), ("''",), ("plain",)]


@query(f"""SELECT text, CASE WHEN length(text) >= 2 AND text[1] = text[-1] AND text[1] IN ('"', '''', '`') THEN text[2:-2] ELSE text END AS bare FROM {values_sql(["text"], _QUOTED)}""")
def p13_strip_quotes(spark, sf_dir):
    return rows(spark, "text STRING", _QUOTED).select("text", text.strip_quotes(F.col("text")).alias("bare"))


_PATHS = [
    ("/src/app/main.ts",), ("C:\\logs\\Kernel_Log.0",), ("notes.md",), (".env",), ("dir.d/readme",), ("a/catalog_log",), ("a/crash_log_2",), ("x/y.TAR.GZ",), ("data/main.log",), ("archive.",), ("mylogs",), ("sys_log",), ("doc.pug",), ("lib/util.mjs",), ("page.html#top",), ("",),
]
_PATHS_SQL = f"(SELECT path FROM {values_sql(['path'], _PATHS)} UNION ALL SELECT url AS path FROM pages)"


def _paths(spark, sf_dir):
    return rows(spark, "path STRING", _PATHS).unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


_BASE = "regexp_extract(path, '([^/]*)/*$', 1)"


@query(
    f"SELECT path, {D.extension('path')} AS ext, regexp_extract({_BASE}, '(?s)^.+?(\\.[^.]*)$', 1) AS dotted, {_BASE} AS base, {D.file_name('path')} AS name, {D.language(D.extension('path'))} AS lang, {D.language(chr(108) + 'ower(regexp_extract(path, ' + D.text(chr(92) + '.([^.]*)$') + ', 1))')} AS source_lang FROM {_PATHS_SQL}"
)
def p14_path_parts(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select(
        "path", paths.extension(p).alias("ext"), paths.dotted_extension(p).alias("dotted"), paths.base_name(p).alias("base"), paths.file_name(p).alias("name"), paths.language(paths.extension(p)).alias("lang"), paths.language_of_source(p).alias("source_lang")
    )


@query(
    f"""SELECT path, CASE WHEN by_ext OR len(words) > 0 THEN 'structured' END AS type, NOT by_ext AND len(words) = 0 AND ext IN {D.words(P.AMBIGUOUS_EXTENSIONS)} AS ambiguous, ext, CASE WHEN by_ext THEN '' ELSE array_to_string(words, ',') END AS keywords
    FROM (SELECT path, {D.extension('path')} AS ext, {D.extension('path')} IN {D.words(P.STRUCTURED_EXTENSIONS)} AS by_ext, {D.keywords(D.file_name('path'), P.FILTER_KEYWORDS)} AS words FROM {_PATHS_SQL})"""
)
def p17_ext_filter(spark, sf_dir):
    out = _paths(spark, sf_dir).withColumn("f", paths.filter_result(F.col("path")))
    return out.select("path", "f.type", "f.ambiguous", "f.ext", F.array_join("f.keywords", ",").alias("keywords"))


@query(f"SELECT path, array_to_string({D.keywords(f'lower({_BASE})', P.DECISION_KEYWORDS)}, ',') AS keywords FROM {_PATHS_SQL}")
def p18_name_keywords(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", F.array_join(paths.keywords(F.lower(paths.base_name(F.col("path"))), P.DECISION_KEYWORDS), ",").alias("keywords"))


_IMPORTS = [("/p/src/a.ts", "./b"), ("/p/src/a.ts", "../lib/c"), ("/p/src/a.ts", "react"), ("/p/a.ts", "./x.js"), ("/p/src/deep/a.ts", "../../q")]
_RESOLVED = [("/p/src/a.ts", "./b", "/p/src/b"), ("/p/src/a.ts", "../lib/c", "/p/lib/c"), ("/p/a.ts", "./x.js", "/p/x.js"), ("/p/src/deep/a.ts", "../../q", "/p/q")]
_TAILS = [(0, "")] + [(i + 1, e) for i, e in enumerate(P.IMPORT_EXTENSIONS)] + [(i + 9, "/index" + e) for i, e in enumerate(P.IMPORT_EXTENSIONS)]


@query(f"SELECT importer, source, rank, base || tail AS candidate FROM {values_sql(['importer', 'source', 'base'], _RESOLVED)}, {values_sql(['rank', 'tail'], _TAILS)}")
def p21_import_candidates(spark, sf_dir):
    out = rows(spark, "importer STRING, source STRING", _IMPORTS)
    return out.select("importer", "source", F.posexplode(paths.import_candidates_column("importer", "source")).alias("rank", "candidate"))


def _damaged(spark, sf_dir):
    """Documents of which some hold control characters."""
    n = F.col("doc_id") % 5
    put = F.when(n == 0, F.concat(F.lit("\0"), F.col("text"))).when(n == 1, F.concat(F.repeat(F.lit("\x01\x02 "), 400), F.col("text"))).when(n == 2, F.concat(F.repeat(F.lit("\x0b\x1f;"), 30), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", put.alias("text")).unionByName(table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("doc_id"), F.col("html").alias("text")))


_DAMAGED_SQL = "(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN chr(0) || text WHEN 1 THEN repeat(chr(1) || chr(2) || ' ', 400) || text WHEN 2 THEN repeat(chr(11) || chr(31) || ';', 30) || text ELSE text END AS text FROM documents UNION ALL SELECT -page_id - 1, html FROM pages)"


@query(f"SELECT doc_id, {D.binary('text')} AS is_binary, round({D.symbol_ratio('text')}, 9) AS symbols, {D.count('substr(text, 1, 100000)', P.TAG_START)} > 30 AS is_markup, {D.binary_for_digest('text')} AS digest_binary FROM {_DAMAGED_SQL}")
def p23_binary_gates(spark, sf_dir):
    t = F.col("text")
    return _damaged(spark, sf_dir).select("doc_id", text.binary(t).alias("is_binary"), F.round(text.symbol_ratio(t), 9).alias("symbols"), text.markup(t).alias("is_markup"), text.binary_for_digest(t).alias("digest_binary"))


_JSON = [('{"a":1}',), ("[1,2]",), ("3",), ("null",), ('"s"',), ("{",), ("[1,2",), ("",), ("plain text",), ('  {"b": [true, null]} ',)]


@query(f"SELECT text, CASE WHEN json_valid({D.trim('text')}) THEN regexp_matches({D.trim('text')}, '^[\\[{{]') ELSE false END AS valid FROM (SELECT text FROM {values_sql(['text'], _JSON)} UNION ALL SELECT props FROM events)")
def c04_json_valid(spark, sf_dir):
    out = rows(spark, "text STRING", _JSON).unionByName(table(spark, sf_dir, "events").select(F.col("props").alias("text")))
    return out.select("text", C.json_valid(F.col("text")).alias("valid"))


_BOTH_SQL = f"({S.DOCUMENTS_SQL} UNION ALL {S.pages_sql(False)})"


def _both(spark, sf_dir):
    return S.documents(spark, sf_dir).unionByName(S.pages(spark, sf_dir, with_path=False))


@query(
    f"SELECT key, {D.symbol_ratio('text')} > 0.008 AS strong_symbol, {D.tag_density('text')} > 1 AS markup_tag, {D.has('text', P.ANSI)} AS ansi, coalesce({D.line_structured('kept')}, false) AS line_structured, round({D.prose_ratio('text')}, 9) AS prose_ratio FROM (SELECT *, {D.plain_lines('text')} AS kept FROM {_BOTH_SQL})"
)
def c05_signals(spark, sf_dir):
    t = F.col("text")
    return _both(spark, sf_dir).select(
        "key", (text.symbol_ratio(t) > P.SYMBOL_RATIO).alias("strong_symbol"), (C.tag_density(t) > 1).alias("markup_tag"), text.found(t, P.ANSI).alias("ansi"), F.coalesce(C.line_structured(t), F.lit(False)).alias("line_structured"), F.round(C.prose_ratio(t), 9).alias("prose_ratio")
    )


_CHINESE = [
    ("a", "这是一个测试,因为我们需要它。\n那也是可以的,所以我们都在这里。\n\n如果需要,应该给他们。\nplain line"), ("b", "这是的\nno markers\n那是的\n也是的"), ("c", "nothing here\nat all"), ("d", "是的。\n\n\n不是的。\n都是的。"),
]


@query(f"SELECT key, {D.prose_run('text')} AS run FROM {values_sql(['key', 'text'], _CHINESE)}")
def c10_prose_runs(spark, sf_dir):
    return rows(spark, "key STRING, text STRING", _CHINESE).select("key", C.prose_run(F.col("text")).cast("long").alias("run"))


@query(f"SELECT key, type, round(confidence, 9) AS confidence, array_to_string(signals, ',') AS signals FROM {D.classified(S.CAPTURES_SQL)}")
def c13_classify(spark, sf_dir):
    out = C.with_class(S.captures(spark, sf_dir), "r")
    return out.select("key", "r.type", F.round("r.confidence", 9).alias("confidence"), F.array_join("r.signals", ",").alias("signals"))


@query(f"SELECT key, type, round(confidence, 9) AS confidence, array_to_string(signals, ',') AS signals FROM {D.classified(f'({S.CAPTURES_SQL} UNION ALL {S.JSON_SQL})')}")
def c13_classify_with_json(spark, sf_dir):
    """With captures that are JSON lists."""
    out = C.with_class(S.captures(spark, sf_dir).unionByName(S.json_lists(spark, sf_dir)), "r")
    return out.select("key", "r.type", F.round("r.confidence", 9).alias("confidence"), F.array_join("r.signals", ",").alias("signals"))


@query(f"SELECT key, CASE WHEN type IN ('prose', 'mixed') THEN text ELSE text1 END = text AS unchanged, type FROM (SELECT key, type, text0 AS text, text1 FROM {D.strip_cte(D.classified(S.CAPTURES_SQL), 'key, type')})")
def p30_dispatch(spark, sf_dir):
    """Prose and mixed captures pass byte for byte."""
    out = text.with_strip(C.with_class(S.captures(spark, sf_dir), "r"), "s")
    sent = F.when(F.col("r.type").isin("prose", "mixed"), F.col("text")).otherwise(F.col("s.text"))
    return out.select("key", (sent == F.col("text")).alias("unchanged"), "r.type")


_QUIRKS = [
    ("[ERROR] x",), ("ERROR: x",), ("error: x",), ("WARNING: x",), ("npm ERR! x",), ("12 failed",), ("5 tests",), ("at the end of",), ("java.lang.NullPointerException: x",), ("2024-01-01 00:00:07 CRITICAL x",), ("01-02 03:04:05.678 I Svc: warning level",),
    ("<p> error",), ("<div> error",), ("TypeError: bad",), ("✗ broken",), ("not ok 3",), ("Caused by: y",), ("#12 0xdead",), ("src/a.ts:3:7: error TS1",), ("Tests: 3 total",), ("2024-01-01T00:00:07 W oops",), ("2024-01-01 00:00:07 E oops",), ("2024-01-01 00:00:07 INFO fine",), ("plain",), ("  3 passing",), ("Traceback (most recent call last):",), ("Errors happen",),
]


@query(f"SELECT line, {D.kind('line')} AS kind FROM {values_sql(['line'], _QUIRKS)}")
def c14_quirks(spark, sf_dir):
    return rows(spark, "line STRING", _QUIRKS).select("line", Z.signal_kind(F.col("line")).alias("kind"))


@query(f"SELECT key, kind, count(*) AS n FROM (SELECT key, {D.kind('line')} AS kind FROM (SELECT key, unnest({D.lines('text')}) AS line FROM ({S.logs_sql(colour=False)})) WHERE NOT {D.blank('line')}) GROUP BY key, kind")
def c14_signal_lines(spark, sf_dir):
    out = S.logs(spark, sf_dir, colour=False).select("key", F.explode(text.lines(F.col("text"))).alias("line")).where(~text.blank(F.col("line")))
    return out.select("key", Z.signal_kind(F.col("line")).alias("kind")).groupBy("key", "kind").agg(F.count("*").alias("n"))


_LOGS_BOTH = f"({S.logs_sql(colour=False)} UNION ALL SELECT 'p' || key, path, tool, session, seq, text FROM ({S.logs_sql(colour=False, props=True)}))"


@query(f"SELECT key, d_method AS method, signals, fails, warns, errors, gate, {D.units('d_text')} AS size, md5(d_text) AS digest FROM {D.digested(_LOGS_BOTH, 'key')}")
def c16_digest(spark, sf_dir):
    logs = S.logs(spark, sf_dir, colour=False).unionByName(S.logs(spark, sf_dir, colour=False, props=True).withColumn("key", F.concat(F.lit("p"), F.col("key"))))
    out = Z.with_digest(logs.select("key", "text"), "text", "d")
    whole = lambda c: F.col(f"d.{c}").cast("long").alias(c)
    return out.select("key", "d.method", whole("signals"), whole("fails"), whole("warns"), whole("errors"), "d.gate", text.units(F.col("d.text")).cast("long").alias("size"), F.md5("d.text").alias("digest"))


@query(f"SELECT key, md5(text) AS digest FROM {D.digested(f'({S.logs_sql(colour=False)})', 'key')} WHERE gate IS NULL")
def p08_digest_restore(spark, sf_dir):
    out = Z.with_digest(S.logs(spark, sf_dir, colour=False).select("key", "text"), "text", "d").where("d.handle IS NOT NULL")
    back = Z.digest_restore(out.select("d.handle", "d.text"), out.select("d.handle", F.col("text").alias("content")))
    return out.select("key", "d.handle").join(back, "handle").select("key", F.md5("text").alias("digest"))


_CAPTURES_P09 = f"(SELECT key, text1 AS text, text0, method FROM {D.strip_cte(f'({S.logs_sql()} UNION ALL {S.LONG_SQL})', 'key')})"
_S9 = D.snip_parts("d_text")


@query(
    f"""SELECT key, {D.units('text0')} AS original_size, CASE WHEN {D.units('text0')} < 512 THEN {D.units('text0')} ELSE {D.units('s_text')} END AS compressed_size, CASE WHEN {D.units('text0')} < 512 THEN '' ELSE array_to_string(list_filter([CASE WHEN method NOT LIKE '%:noop' THEN method END, CASE WHEN d_method NOT LIKE '%:noop' THEN d_method END, CASE WHEN was_cut THEN 'snip' END], lambda z: z IS NOT NULL), ',') END AS steps
    FROM (SELECT *, {_S9['cut']} AS was_cut, CASE WHEN {_S9['cut']} THEN {_S9['kept']} ELSE d_text END AS s_text FROM {D.digested(_CAPTURES_P09, 'key, text0, method')})"""
)
def p09_pipeline(spark, sf_dir):
    out = Z.with_compression(S.logs(spark, sf_dir).unionByName(S.long_texts(spark, sf_dir)).select("key", "text"), "text", "c")
    return out.select("key", F.col("c.original_size").cast("long").alias("original_size"), F.col("c.compressed_size").cast("long").alias("compressed_size"), F.array_join("c.steps", ",").alias("steps"))


@query(f"SELECT key, true AS equal FROM ({S.logs_sql()} UNION ALL {S.LONG_SQL})")
def p10_round_trip(spark, sf_dir):
    """Every stage undone gives a text that is equal but for white space and terminal codes."""
    out = Z.with_compression(S.logs(spark, sf_dir).unionByName(S.long_texts(spark, sf_dir)).select("key", "text"), "text", "c")
    return out.select("key", Z.round_trip_equal(F.col("text"), F.col("c.text"), F.col("c.snippets")).alias("equal"))


_MARKDOWN = [
    ("a", "---\ntitle: x\n---\n# Head\n" + "A long paragraph of running text that goes on. " * 4 + "\n\n```\ncode " + "x" * 200 + "\n```\n" + "Second paragraph, also long enough to be counted. " * 3),
    ("b", "short\n\n| a | b |\n- item\n<div>x</div>\n    code"), ("c", "Open fence follows, so that this long paragraph is kept and what comes after is not. " * 2 + "\n~~~\n" + "lost " * 60),
]


@query(
    "SELECT * FROM "
    + values_sql(["key", "n", "block"], [("a", 0, ("A long paragraph of running text that goes on. " * 4).strip()), ("a", 1, ("Second paragraph, also long enough to be counted. " * 3).strip()), ("c", 0, ("Open fence follows, so that this long paragraph is kept and what comes after is not. " * 2).strip())])
)
def p32_prose_blocks(spark, sf_dir):
    return rows(spark, "key STRING, text STRING", _MARKDOWN).select("key", F.posexplode(corpus.prose_blocks_column("text")).alias("n", "block"))


# Store, search and metrics -----------------------------------------------------------------------------------------------

def _originals(spark, sf_dir):
    return S.long_texts(spark, sf_dir).select(F.col("key").alias("handle"), F.col("text").alias("content"), F.col("session").alias("source"), F.col("seq").alias("created_at"))


_CHUNKS_SQL = f"(SELECT * FROM (SELECT handle, CAST(i * 20 + 1 AS INT) AS line_no, array_to_string(ls[i * 20 + 1:i * 20 + 20], chr(10)) AS content FROM (SELECT handle, ls, unnest(range(0, CAST(ceil(len(ls) / 20.0) AS BIGINT))) AS i FROM (SELECT key AS handle, {D.lines('text')} AS ls FROM ({S.LONG_SQL})))) WHERE NOT {D.blank('content')})"


@query(f"SELECT handle, line_no, md5(content) AS digest FROM {_CHUNKS_SQL}")
def w03_chunks(spark, sf_dir):
    return store.chunks(_originals(spark, sf_dir)).select("handle", "line_no", F.md5("content").alias("digest"))


@query("SELECT source, 'o-' || max(doc_id) AS handle, CAST(max(doc_id) AS BIGINT) AS created_at FROM documents GROUP BY source")
def s03_latest_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("o-"), F.col("doc_id")).alias("handle"), "source", F.col("doc_id").alias("created_at"))
    return store.latest_by_source(docs)


@query("SELECT * FROM (SELECT CAST(doc_id % 50 AS VARCHAR) AS handle, md5(text) AS digest, CAST(doc_id AS BIGINT) AS created_at FROM documents) QUALIFY row_number() OVER (PARTITION BY handle ORDER BY created_at DESC) = 1")
def w02_upsert(spark, sf_dir):
    log = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).cast("string").alias("handle"), F.col("text").alias("content"), F.col("doc_id").alias("created_at"))
    return store.upserted(log).select("handle", F.md5("content").alias("digest"), "created_at")


@query("SELECT CAST(doc_id AS VARCHAR) AS handle, length(text) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS size FROM documents")
def w04_replace_by_handle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("handle"), F.length("text").alias("size"), "doc_id")
    new = docs.where("doc_id % 3 = 0").select("handle", (F.col("size") + 1).alias("size"))
    once = store.replaced(docs.select("handle", "size"), new, "handle")
    return store.replaced(once, new, "handle")


@query(f"SELECT handle, retrieved_count FROM {_METRICS_SQL}")
def w07_retrieval_counts(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return store.with_retrievals(m, _retrievals(m)).select("handle", "retrieved_count")


@query("SELECT doc_id, 'orig-' || lower(to_base(doc_id + 1, 36)) AS handle, length(text) AS size FROM documents")
def w01_original_handles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), "source", F.lit(None).cast("string").alias("tool"), F.lit(0).alias("created_at"))
    out = store.as_originals(docs, F.col("doc_id") + 1).withColumn("doc_id", F.conv(F.substring("handle", 6, 20), 36, 10).cast("long") - 1)
    return out.select("doc_id", "handle", "size")


_TOKENS = r"list_transform(regexp_extract_all(lower(strip_accents(content)), '[\p{L}\p{N}\p{Co}]+'), lambda z: z)"


@query(f"SELECT handle, line_no, len(t) AS n, len(list_distinct(t)) AS n_distinct FROM (SELECT handle, line_no, {_TOKENS} AS t FROM {_CHUNKS_SQL})")
def f02_tokens(spark, sf_dir):
    out = store.chunks(_originals(spark, sf_dir)).withColumn("t", search.tokens(F.col("content")))
    return out.select("handle", "line_no", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


_SEARCH_SQL = f"""SELECT handle, line_no, round(-(idf1 * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + idf2 * tf2 * 2.2 / (tf2 + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS rank FROM (SELECT *, greatest(ln((n - n1 + 0.5::DOUBLE) / (n1 + 0.5::DOUBLE)), 1e-6) AS idf1, greatest(ln((n - n2 + 0.5::DOUBLE) / (n2 + 0.5::DOUBLE)), 1e-6) AS idf2
  FROM (SELECT *, count(*) OVER () AS n, avg(dl) OVER () AS avgdl, count(*) FILTER (WHERE tf1 > 0) OVER () AS n1, count(*) FILTER (WHERE tf2 > 0) OVER () AS n2
  FROM (SELECT handle, line_no, len(t) AS dl, len(list_filter(t, lambda z: z = 'thing')) AS tf1, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf2 FROM (SELECT handle, line_no, {_TOKENS} AS t FROM {_CHUNKS_SQL})))) WHERE tf1 > 0 AND tf2 > 0"""


@query(f"{_SEARCH_SQL} ORDER BY rank, handle, line_no LIMIT 50")
def f01_search(spark, sf_dir):
    """A word and a phrase over all handles."""
    found = search.search(store.chunks(_originals(spark, sf_dir)), "Thing of.the", limit=None)
    return found.select("handle", "line_no", F.round("rank", 6).alias("rank")).orderBy("rank", "handle", "line_no").limit(50)


@query(f"SELECT * FROM ({_SEARCH_SQL}) WHERE handle = 'src-src1-0' ORDER BY rank, handle, line_no LIMIT 10")
def f03_search_in_handle(spark, sf_dir):
    """The handle filters the result; statistics stay global."""
    found = search.search(store.chunks(_originals(spark, sf_dir)), "Thing of.the", handle="src-src1-0", limit=None)
    return found.select("handle", "line_no", F.round("rank", 6).alias("rank")).orderBy("rank", "handle", "line_no").limit(10)


@query(
    f"SELECT count(*) AS total, count(*) FILTER (WHERE compressed_size < original_size) AS compressed, CAST(sum(original_size) AS BIGINT) AS total_original, CAST(sum(compressed_size) AS BIGINT) AS total_compressed, CAST(greatest(0, sum(original_size) - sum(compressed_size)) AS BIGINT) AS saved, round(greatest(0, sum(original_size) - sum(compressed_size)) / sum(original_size), 9) AS saved_ratio, CAST(sum(retrieved_count) AS BIGINT) AS retrieved FROM {_METRICS_SQL} WHERE {_COUNTED}"
)
def a01_summary(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return metrics.summary(store.with_retrievals(m, _retrievals(m))).withColumn("saved_ratio", F.round("saved_ratio", 9))


@query(f"SELECT content_type, count(*) AS n, CAST(sum(original_size - compressed_size) AS BIGINT) AS saved FROM {_METRICS_SQL} WHERE {_COUNTED} GROUP BY content_type")
def a02_by_type(spark, sf_dir):
    return metrics.by_type(_metrics(spark, sf_dir))


_SESSIONS_SQL = f"SELECT session_id, count(*) AS n, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum(compressed_size) AS BIGINT) AS compressed, CAST(max(created_at) AS BIGINT) AS last_at, CAST(greatest(0, sum(original_size) - sum(compressed_size)) AS BIGINT) AS saved FROM {_METRICS_SQL} WHERE {_COUNTED} GROUP BY session_id ORDER BY last_at DESC, session_id NULLS FIRST LIMIT 5"


@query(_SESSIONS_SQL)
def a03_by_session(spark, sf_dir):
    return metrics.by_session(_metrics(spark, sf_dir))


_RECENT_SQL = f"SELECT id, tool, content_type, original_size, compressed_size, greatest(0, original_size - compressed_size) AS saved, CAST(CASE WHEN original_size > 0 THEN floor((1 - compressed_size / original_size) * 100 + 0.5) ELSE 0 END AS BIGINT) AS saved_pct, method, CAST(retrieved_count AS BIGINT) AS retrieved_count, session_id, created_at FROM {_METRICS_SQL} WHERE {_COUNTED} ORDER BY created_at DESC, id DESC LIMIT 30"


@query(_RECENT_SQL)
def a04_recent(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return metrics.recent(store.with_retrievals(m, _retrievals(m)))


@query(
    f"SELECT 1 AS part, 'records ' || count(*) || ' compressed ' || count(*) FILTER (WHERE compressed_size < original_size) || ' saved ' || CAST(greatest(0, sum(original_size) - sum(compressed_size)) AS BIGINT) || ' of ' || CAST(sum(original_size) AS BIGINT) || ' retrieved ' || CAST(sum(retrieved_count) AS BIGINT) AS line FROM {_METRICS_SQL} WHERE {_COUNTED} UNION ALL "
    f"SELECT 3, content_type || ' ' || n || ' ' || saved FROM (SELECT content_type, count(*) AS n, CAST(sum(original_size - compressed_size) AS BIGINT) AS saved FROM {_METRICS_SQL} WHERE {_COUNTED} GROUP BY content_type) UNION ALL SELECT 4, coalesce(substr(session_id, 1, 8), '(unknown)') || ' ' || n || ' ' || saved FROM ({_SESSIONS_SQL}) "
    f"UNION ALL SELECT 2, rpad(coalesce(tool, '?'), 5, ' ') || ' ' || rpad(content_type, 10, ' ') || ' ' || lpad(CAST(original_size AS VARCHAR), 6, ' ') || ' ' || lpad(CAST(compressed_size AS VARCHAR), 6, ' ') || ' ' || lpad(CAST(saved_pct AS VARCHAR), 4, ' ') || '%' FROM ({_RECENT_SQL})"
)
def q02_stats(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return metrics.stats_lines(store.with_retrievals(m, _retrievals(m))).select("part", "line")


# Decisions and corpus ----------------------------------------------------------------------------------------------------

def _named(spark, sf_dir):
    """Captures of which a third of those without a path have one whose name holds a keyword of the decision log."""
    path = F.coalesce("path", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("/data/stats_"), F.col("seq").cast("string"), F.lit(".md"))))
    return S.captures(spark, sf_dir).withColumn("path", path)


def _decisions(spark, sf_dir):
    return S.once(spark, sf_dir, "decisions", lambda spark, sf_dir: corpus.decisions(C.with_class(_named(spark, sf_dir), "result").withColumn("ts", F.col("seq").cast("long"))))


_NAMED_SQL = f"(SELECT * REPLACE (coalesce(path, CASE WHEN seq % 3 = 0 THEN '/data/stats_' || seq || '.md' END) AS path) FROM {S.CAPTURES_SQL})"
_DECISIONS_SQL = f"(SELECT path, coalesce(regexp_extract({_BASE}, '(?s)^.+?(\\.[^.]*)$', 1), '') AS ext, {D.keywords(f'lower(coalesce({_BASE}, {chr(39)}{chr(39)}))', P.DECISION_KEYWORDS)} AS words, {D.units('text')} AS size, type, confidence, seq AS ts, key FROM {D.classified(_NAMED_SQL)})"


@query(f"SELECT CASE WHEN ext = '' THEN '(none)' ELSE ext END AS ext, type, count(*) AS n FROM {_DECISIONS_SQL} GROUP BY ALL")
def a05_decisions_by_ext(spark, sf_dir):
    return corpus.by_extension(_decisions(spark, sf_dir))


@query(f"SELECT array_to_string(words, ',') AS keywords, type, count(*) AS n FROM {_DECISIONS_SQL} WHERE len(words) > 0 GROUP BY ALL")
def a06_decisions_by_keyword(spark, sf_dir):
    return corpus.by_keywords(_decisions(spark, sf_dir))


@query(f"SELECT type, count(*) AS n FROM {_DECISIONS_SQL} GROUP BY type")
def a07_decisions_by_type(spark, sf_dir):
    return corpus.by_type(_decisions(spark, sf_dir))


@query(f"SELECT path, size, type, round(confidence, 9) AS confidence, CAST(ts AS BIGINT) AS ts FROM {_DECISIONS_SQL} WHERE confidence < 0.6 ORDER BY ts, path NULLS FIRST, size LIMIT 30")
def t05_low_confidence(spark, sf_dir):
    return corpus.low_confidence(_decisions(spark, sf_dir)).select("path", "size", "type", F.round("confidence", 9).alias("confidence"), "ts")


def _bucketed(spark, sf_dir):
    """Pages and documents with the buckets and types of their made-up file names, as the evaluation stores them."""
    return S.once(spark, sf_dir, "bucketed", _bucketed_rows)


def _files(spark, sf_dir):
    rows_ = _both(spark, sf_dir).withColumn("path", F.concat("key", F.element_at(F.array(*map(F.lit, (".md", ".ts", ".txt"))), (F.col("seq") % 3 + 1).cast("int"))))
    return rows_.withColumn("bucket", corpus.bucket(F.col("path"), F.col("text"), text.binary(F.col("text"))))


def _bucketed_rows(spark, sf_dir):
    return C.with_class(_files(spark, sf_dir), "r", tool="", path="").select("key", "path", "seq", "bucket", F.col("r.type").alias("type"), F.col("r.confidence").alias("confidence"))


def _markdown_blocks(spark, sf_dir):
    """path, n, text and class of the paragraphs of the Markdown files, between which headings and fences have been put."""
    return S.once(spark, sf_dir, "blocks", _block_rows)


def _block_rows(spark, sf_dir):
    files = _files(spark, sf_dir).where("path LIKE '%.md'")
    return C.with_class(files.select("path", F.posexplode(corpus.prose_blocks_column("text")).alias("n", "text")), "r", tool="", path="")


_BUCKETED_SQL = f"(SELECT key, seq, text, type, CASE WHEN {D.binary('text')} THEN 'binary' WHEN {D.units('text')} < 50 THEN 'skip' WHEN seq % 3 = 0 THEN 'observe' WHEN seq % 3 = 1 THEN 'structured' ELSE 'prose-candidate' END AS bucket FROM {D.classified(f'(SELECT key, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS tool, seq, text FROM {_BOTH_SQL})')})"


@query(f"SELECT bucket, type, count(*) AS n FROM {_BUCKETED_SQL} GROUP BY ALL")
def a09_confusion(spark, sf_dir):
    return corpus.confusion(_bucketed(spark, sf_dir))


@query()
def a10_prose_rate(spark, sf_dir):
    """Paragraphs of Markdown files that are taken for structured; the paragraphs come from a state machine, so there is no SQL."""
    return corpus.misjudged_prose(_markdown_blocks(spark, sf_dir).select(F.col("r.type").alias("type"))).withColumn("rate", F.round("rate", 9))


@query()
def p32_prose_blocks_of_files(spark, sf_dir):
    return _markdown_blocks(spark, sf_dir).select("path", "n", F.md5("text").alias("digest"))


@query()
def t06_samples(spark, sf_dir):
    """The first 20 paragraphs that the classifier isn't sure of."""
    return corpus.samples(_markdown_blocks(spark, sf_dir), F.col("r.confidence") < 0.6)


@query(f"SELECT CASE seq % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'ts' ELSE 'txt' END AS ext, type, count(*) AS n FROM {_BUCKETED_SQL} WHERE bucket = 'observe' GROUP BY ALL ORDER BY ext, n DESC, type")
def a11_observed(spark, sf_dir):
    return corpus.observed(_bucketed(spark, sf_dir))


@query(f"SELECT ext, count(*) AS n FROM (SELECT CASE WHEN key LIKE 'page%' THEN 'p' || (seq % 40) ELSE 'd' || (seq % 31) END AS ext FROM {_BUCKETED_SQL}) GROUP BY ext ORDER BY n DESC, ext LIMIT 15")
def t07_commonest(spark, sf_dir):
    """The 15 commonest of some dozens of made-up extensions."""
    ext = F.when(F.col("key").like("page%"), F.concat(F.lit("p"), (F.col("seq") % 40).cast("string"))).otherwise(F.concat(F.lit("d"), (F.col("seq") % 31).cast("string")))
    return corpus.commonest(_bucketed(spark, sf_dir).select(ext.alias("ext")), "ext", limit=15)


@query(f"SELECT type, count(*) AS n FROM {_BUCKETED_SQL} GROUP BY type ORDER BY n DESC, type")
def t08_by_count(spark, sf_dir):
    return corpus.commonest(_bucketed(spark, sf_dir), "type")


@query(f"SELECT array_to_string(words, ',') AS keywords, type, count(*) AS n FROM {_DECISIONS_SQL} WHERE len(words) > 0 GROUP BY ALL ORDER BY keywords, type")
def t09_by_key(spark, sf_dir):
    return corpus.ordered_by_key(_decisions(spark, sf_dir))


def _decision_lines(spark, sf_dir):
    """A decision log with lines that can't be read, and empty ones."""
    row = F.to_json(F.struct(*(F.col(c) for c in ("path", "ext", "filename", "nameKeywords", "size", "type", "confidence", "signals", "tool", "ts"))))
    broken = F.when(F.col("ts") % 7 == 0, F.concat(F.lit("{"), row)).when(F.col("ts") % 11 == 0, F.lit("")).when(F.col("ts") % 13 == 0, F.lit("[]")).otherwise(row)
    return _decisions(spark, sf_dir).select(broken.alias("value"))


@query(f"SELECT count(*) FILTER (WHERE ts % 7 = 0 OR ts % 11 <> 0) AS total, count(*) FILTER (WHERE ts % 7 <> 0 AND ts % 11 <> 0 AND ts % 13 <> 0) AS records FROM {_DECISIONS_SQL}")
def a08_line_total(spark, sf_dir):
    return corpus.line_total(_decision_lines(spark, sf_dir))


@query(f"SELECT path, size, type, round(confidence, 9) AS confidence, CAST(ts AS BIGINT) AS ts FROM {_DECISIONS_SQL} WHERE ts % 7 <> 0 AND ts % 11 <> 0 AND ts % 13 <> 0")
def s06_read_decisions(spark, sf_dir):
    return corpus.read_decisions(_decision_lines(spark, sf_dir)).select("path", "size", "type", F.round("confidence", 9).alias("confidence"), "ts")


@query(
    f"""SELECT 'bucket' AS section, bucket AS key, CAST(NULL AS VARCHAR) AS type, count(*) AS n, CAST(NULL AS DOUBLE) AS share FROM {_BUCKETED_SQL} GROUP BY bucket
    UNION ALL SELECT 'confusion', 'structured', type, count(*), round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) FROM {_BUCKETED_SQL} WHERE bucket = 'structured' GROUP BY type
    UNION ALL SELECT 'observe', 'md', type, count(*), round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) FROM {_BUCKETED_SQL} WHERE bucket = 'observe' GROUP BY type"""
)
def q07_evaluation(spark, sf_dir):
    """The evaluation report without its paragraphs, which a10 counts."""
    return corpus.evaluation(_bucketed(spark, sf_dir), _markdown_blocks(spark, sf_dir).select(F.col("r.type").alias("type"))).where("section <> 'prose'")


@query("SELECT DISTINCT doc_id, true AS found FROM documents WHERE doc_id IN (3, 7)")
def s04_has_symbols(spark, sf_dir):
    """Existence by handle."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("handle"))
    known = [i for i in (3, 7, -5) if store.has_symbols(docs, str(i))]
    return rows(spark, "doc_id BIGINT, found BOOLEAN", [(i, True) for i in known])


@query(f"SELECT doc_id, md5(text1) AS digest FROM {D.strip_cte(f'({S.NOISY_SQL})', 'doc_id')}")
def p04_format_restore(spark, sf_dir):
    return text.with_strip(S.noisy(spark, sf_dir), "s").select("doc_id", F.md5(text.format_restore(F.col("s.text"))).alias("digest"))


@query(f"SELECT bucket, count(*) AS n FROM {_BUCKETED_SQL} GROUP BY bucket")
def a12_buckets(spark, sf_dir):
    return _bucketed(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"))


_SOURCES_SQL = f"({S.logs_sql()} UNION ALL {S.pages_sql(False)})"


@query(
    f"""SELECT ext, type, count(*) AS n, count(*) FILTER (WHERE compressed) AS compressed, count(*) FILTER (WHERE d_method = 'structured-digest' AND compressed) AS digested, CAST(sum(CASE WHEN compressed THEN {D.units('text0')} ELSE 0 END) AS BIGINT) AS original, CAST(sum(CASE WHEN compressed THEN {D.units('s_text')} ELSE 0 END) AS BIGINT) AS after, count(*) FILTER (WHERE compressed AND type IN ('prose', 'mixed')) AS leaks
    FROM (SELECT *, type = 'structured' AND {D.units('text0')} >= 512 AND (method NOT LIKE '%:noop' OR d_method = 'structured-digest' OR was_cut) AS compressed FROM (SELECT *, {_S9['cut']} AS was_cut, CASE WHEN {_S9['cut']} THEN {_S9['kept']} ELSE d_text END AS s_text
    FROM {D.digested(f"(SELECT key, ext, type, text1 AS text, text0, method FROM {D.strip_cte(f'(SELECT *, split_part(key, {chr(39)}-{chr(39)}, 1) AS ext FROM {D.classified(_SOURCES_SQL)})', 'key, ext, type')})", 'key, ext, type, text0, method')})) GROUP BY ext, type"""
)
def a13_corpus(spark, sf_dir):
    """Logs and pages measured as a corpus: classified, and structured ones compressed."""
    rows_ = C.with_class(S.logs(spark, sf_dir).unionByName(S.pages(spark, sf_dir, with_path=False)), "r").withColumn("type", F.col("r.type"))
    rows_ = Z.with_compression(rows_.withColumn("ext", F.split("key", "-")[0]), "text", "c")
    done = (F.col("type") == "structured") & F.col("c.compressed")
    return corpus.measure(rows_.select("ext", "type", done.alias("compressed"), (done & F.array_contains("c.steps", "structured-digest")).alias("digested"), F.col("c.original_size").cast("long").alias("original_size"), F.col("c.compressed_size").cast("long").alias("compressed_size")))


_LISTING = [
    ("app", "package.json", 1), ("app", "src/main.ts", 2), ("app", "src/util.ts", 3), ("app", "README.md", 4), ("app", "node_modules/x/index.js", 5), ("app", "a/b/c/deep.ts", 6), ("notes", "one.md", 1), ("notes", "two.txt", 2),
    ("half", "Cargo.toml", 1), ("half", "src/lib.rs", 2), ("half", "docs/a.md", 3), ("half", "docs/b.md", 4), ("bare", "x.py", 1), ("bare", "y.md", 2), ("other", "data.bin", 1), ("none", "node_modules/a.js", 1),
]
_DIAGNOSED = [
    ("app", "coding", "node-bun", 2, 1, 1, 0.25), ("notes", "docs", "unknown", 0, 2, 0, 1.0), ("half", "mixed", "rust", 1, 2, 1, 0.5), ("bare", "mixed", "unknown", 1, 1, 0, 0.5), ("other", "docs", "unknown", 0, 0, 1, 0.0), ("none", "empty", "unknown", 0, 0, 0, 0.0),
]


@query(f"SELECT project, verdict, subtype, code, docs, other, CAST(docs_ratio AS DOUBLE) AS docs_ratio FROM {values_sql(['project', 'verdict', 'subtype', 'code', 'docs', 'other', 'docs_ratio'], _DIAGNOSED)}")
def q05_diagnosis(spark, sf_dir):
    return diagnosis.diagnose(rows(spark, "project STRING, path STRING, seq INT", _LISTING)).drop("advice")


# Code graph ----------------------------------------------------------------------------------------------------------------

_FILES = [
    ("h1", "/p/a.ts", "import { foo, bar as baz } from './b';\nimport './side';\nimport x from 'pkg';\nexport function run(a) {\n  foo(a);\n  helper(baz(1));\n  obj.go();\n  log(a);\n}\nfunction helper(x) {\n  return x;\n}\n", 10),
    ("h2", "/p/b.ts", "export const foo = (x) => bar(x);\nexport function bar(x) {\n  return later(x);\n}\nclass Box {\n  open() {\n    return this.close();\n  }\n  close() {\n    return bar(2);\n  }\n}\n", 20),
    ("h3", "/p/b.ts", "export const foo = (x) => bar(x);\nexport function bar(x) {\n  return x + 1;\n}\n", 30), ("h4", "/p/d.csv", "a,b\n", 40), ("h5", "/p/side/index.ts", "run();\n", 50),
]
_SYMBOLS = [
    ("h1", "run", "function", 4, 9, True, "function run(a)", "typescript"), ("h1", "helper", "function", 10, 12, False, "function helper(x)", "typescript"), ("h2", "foo", "variable", 1, 1, True, "foo = (x)", "typescript"), ("h2", "bar", "function", 2, 4, True, "function bar(x)", "typescript"),
    ("h2", "Box", "class", 5, 12, False, "class Box", "typescript"), ("h2", "open", "method", 6, 8, False, "open()", "typescript"), ("h2", "close", "method", 9, 11, False, "close()", "typescript"), ("h3", "foo", "variable", 1, 1, True, "foo = (x)", "typescript"), ("h3", "bar", "function", 2, 4, True, "function bar(x)", "typescript"),
]
_EDGES = [
    ("h1", "run", "h3", "foo", "call", 5, True, "./b"), ("h1", "run", "h1", "helper", "call", 6, True, None), ("h1", "run", "h3", "baz", "call", 6, True, "./b"), ("h1", "run", None, "obj.go", "call", 7, False, None), ("h1", "run", None, "log", "call", 8, False, None),
    ("h1", None, "h3", "foo", "import", 1, True, "./b"), ("h1", None, "h3", "bar", "import", 1, True, "./b"), ("h1", None, "h3", "baz", "import", 1, True, "./b"), ("h1", None, "h5", "(side-effect)", "import", 2, True, "./side"), ("h1", None, None, "x", "import", 3, False, "pkg"),
    ("h2", "foo", "h2", "bar", "call", 1, True, None), ("h2", "bar", None, "later", "call", 3, False, None), ("h2", "open", "h2", "close", "call", 7, True, None), ("h2", "close", "h2", "bar", "call", 10, True, None), ("h3", "foo", "h3", "bar", "call", 1, True, None), ("h5", None, None, "run", "call", 1, False, None),
]
_EDGE_COLUMNS = ["from_handle", "from_symbol", "to_handle", "to_symbol", "ref_type", "line", "resolved", "import_src"]
_EDGES_SQL = values_sql(_EDGE_COLUMNS, _EDGES)


def _code(spark):
    originals = rows(spark, "handle STRING, source STRING, content STRING, created_at BIGINT", _FILES)
    files = codegraph.parsed(originals)
    return originals, codegraph.symbols(files), codegraph.edges(files, originals)


@query(f"SELECT * FROM {values_sql(['handle', 'name', 'kind', 'start_line', 'end_line', 'exported', 'signature', 'lang'], _SYMBOLS)}")
def g02_symbols(spark, sf_dir):
    return _code(spark)[1].select("handle", "name", "kind", "start_line", "end_line", "exported", "signature", "lang")


@query(f"SELECT * FROM {_EDGES_SQL}")
def g05_edges(spark, sf_dir):
    return _code(spark)[2].select(*_EDGE_COLUMNS)


@query(f"SELECT name, kind, start_line FROM {values_sql(['handle', 'name', 'kind', 'start_line', 'end_line', 'exported', 'signature', 'lang'], _SYMBOLS)} WHERE handle = 'h2' AND name ILIKE '%o%'")
def g09_find_symbol(spark, sf_dir):
    return codegraph.find_symbol(_code(spark)[1], "h2", "o").select("name", "kind", "start_line")


_SYMBOLS_SQL = values_sql(["handle", "name", "kind", "start_line", "end_line", "exported", "signature", "lang"], _SYMBOLS)


@query(
    f"""SELECT from_handle, from_symbol, line, CASE WHEN from_handle = 'h3' THEN 'same file' ELSE 'cross file' END AS state, source, signature FROM {_EDGES_SQL} e LEFT JOIN (SELECT handle, name, signature FROM {_SYMBOLS_SQL}) s ON s.handle = from_handle AND s.name = from_symbol
    LEFT JOIN {values_sql(["handle", "source"], [(f[0], f[1]) for f in _FILES])} f ON f.handle = from_handle WHERE to_handle = 'h3' AND to_symbol IN ('foo')"""
)
def g11_callers(spark, sf_dir):
    originals, symbols, refs = _code(spark)
    return codegraph.callers(refs, symbols, originals, "h3", "foo").select("from_handle", "from_symbol", "line", "state", "source", "signature")


@query(
    f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGES_SQL}), walk AS (SELECT 1 AS level, * FROM e WHERE from_handle = 'h1' AND from_symbol = 'run' UNION ALL SELECT w.level + 1, e.* FROM walk w JOIN e ON e.from_handle = w.to_handle AND e.from_symbol = w.to_symbol WHERE w.level < 3)
    SELECT w.*, signature, CASE WHEN to_handle = from_handle THEN 'same file' WHEN to_handle IS NOT NULL THEN 'cross file' WHEN import_src IS NOT NULL THEN 'imported, unread' WHEN to_symbol LIKE '%.%' THEN 'member call' ELSE 'unknown' END AS state
    FROM (SELECT min(level) AS level, from_handle, from_symbol, to_handle, to_symbol, line, import_src FROM walk GROUP BY ALL) w LEFT JOIN (SELECT handle, name, signature FROM {_SYMBOLS_SQL}) s ON s.handle = to_handle AND s.name = to_symbol"""
)
def g12_callees_depth3(spark, sf_dir):
    _, symbols, refs = _code(spark)
    return codegraph.callees(refs, symbols, "h1", "run", 3).select("level", "from_handle", "from_symbol", "to_handle", "to_symbol", "line", "import_src", "state", "signature")


@query(
    f"""SELECT name, kind, signature, (SELECT string_agg(line || ':' || to_symbol, ',' ORDER BY line, to_symbol) FROM {_EDGES_SQL} WHERE from_handle = 'h2' AND from_symbol = 'close' AND ref_type = 'call') AS callees,
    (SELECT string_agg(line || ':' || from_symbol, ',' ORDER BY line, from_symbol) FROM {_EDGES_SQL} WHERE to_handle = 'h2' AND to_symbol = 'close') AS callers FROM {_SYMBOLS_SQL} WHERE handle = 'h2' AND name = 'close'"""
)
def g10_symbol_card(spark, sf_dir):
    """The exact lookup comes first: the name of one symbol is part of another's."""
    _, symbols, refs = _code(spark)
    shown = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["line"].cast("string"), F.lit(":"), e["other"])), ",").alias(c)
    return codegraph.symbol_card(refs, symbols, "h2", "close").select("name", "kind", "signature", shown("callees"), shown("callers"))


@query(f"SELECT name, kind, start_line, signature FROM {_SYMBOLS_SQL} WHERE handle = 'h2' ORDER BY start_line")
def s05_symbols_of_file(spark, sf_dir):
    return store.symbols_of(_code(spark)[1], "h2").select("name", "kind", "start_line", "signature")


@query(f"SELECT handle, name, kind, start_line FROM {_SYMBOLS_SQL} WHERE handle = 'h3' AND name = 'bar'")
def c21_exact_symbol(spark, sf_dir):
    return codegraph.find_symbol(_code(spark)[1], "h3", "bar").select("handle", "name", "kind", "start_line")


@query(f"SELECT name, kind, start_line FROM {_SYMBOLS_SQL} WHERE handle = 'h2' AND name ILIKE '%o%'")
def q03_code_symbol(spark, sf_dir):
    from ..operators.api import code_symbol

    return code_symbol(_code(spark)[0], "h2", query="o").select("name", "kind", "start_line")


@query(f"SELECT from_handle, from_symbol, line, source FROM {_EDGES_SQL} JOIN {values_sql(['handle', 'source'], [(f[0], f[1]) for f in _FILES])} f ON f.handle = from_handle WHERE to_handle = 'h2' AND to_symbol = 'bar'")
def q04_code_refs(spark, sf_dir):
    from ..operators.api import code_refs

    originals, symbols, refs = _code(spark)
    return code_refs(originals, "h2", "bar", "callers", tables=(symbols, refs)).select("from_handle", "from_symbol", "line", "source")


@query(f"SELECT * FROM {values_sql(['handle', 'times'], [('src-src1-0', 1), ('src-src2-0', 1), ('h2', 2)])}")
def w07_retrievals_of_tools(spark, sf_dir):
    """Answers with content are counted; a miss, an error and lines beyond the end aren't."""
    from functools import reduce

    from ..operators import api

    originals, code = _sized(spark, sf_dir), _code(spark)[0]
    answers = [
        (api.retrieve(originals, "src-src1-0", start=1, number=2), "src-src1-0"), (api.retrieve(originals, "src-src2-0", start=3, number=1), "src-src2-0"), (api.retrieve(originals, "src-src2-0", start=10**8, number=1), "src-src2-0"), (api.retrieve(originals, "none"), "none"),
        (api.retrieve(originals, None), "none"), (api.code_symbol(code, "h2"), "h2"), (api.code_symbol(code, "h2", symbol="absent"), "h2"), (api.code_refs(code, "h2", "bar", "callers"), "h2"),
    ]
    log = reduce(DataFrame.unionAll, [api.retrievals(x, h) for x, h in answers])
    return log.groupBy("handle").agg(F.count("*").alias("times"))


# Tool events -----------------------------------------------------------------------------------------------------------------

def _events(spark, sf_dir):
    """A hook event for each log: the log as a nested string of the response."""
    logs = S.logs(spark, sf_dir)
    tool = F.when(F.col("seq") % 5 == 0, "Grep").otherwise("Bash")
    body = F.struct(tool.alias("tool_name"), F.struct(F.concat(F.lit("/var/"), F.col("key")).alias("file_path")).alias("tool_input"), F.struct(F.array(F.col("text"), F.lit("short")).alias("parts"), F.lit(3).alias("code")).alias("tool_response"), F.col("session").alias("session_id"))
    return logs.select(F.col("key").alias("event_id"), F.to_json(body).alias("value"))


_EVENT_LOGS = f"(SELECT * REPLACE ('/var/' || key AS path) FROM ({S.logs_sql()}) WHERE seq % 5 <> 0)"
_EVENT_KEYS = "key, path, session, type"
_EVENTS_SQL = f"""(SELECT * FROM (SELECT *, 'orig-' || substr(sha256(text0), 1, 12) AS handle, array_to_string(list_filter([CASE WHEN method NOT LIKE '%:noop' THEN method END, CASE WHEN d_method NOT LIKE '%:noop' THEN d_method END, CASE WHEN was_cut THEN 'snip' END], lambda z: z IS NOT NULL), ',') AS steps
  FROM (SELECT *, {_S9['cut']} AS was_cut, CASE WHEN {_S9['cut']} THEN {_S9['kept']} ELSE d_text END AS s_text FROM {D.digested(f"(SELECT {_EVENT_KEYS}, text1 AS text, text0, method FROM {D.strip_cte(D.classified(_EVENT_LOGS), _EVENT_KEYS)})", f'{_EVENT_KEYS}, text0, method')}))
  WHERE type = 'structured' AND {D.units('text0')} >= 2048 AND steps <> '')"""


@query(
    f"""SELECT key AS event_id, md5(s_text || chr(10) || chr(10) || '[sifter: original kept as ' || handle || ', ' || len({D.lines('text0')}) || ' lines, from ' || path || '. Keywords: retrieve(handle, query); lines: retrieve(handle, start, count); totals: process ' || path || '.]') AS digest, 'short' AS other, '3' AS code, 'PostToolUse' AS hook FROM {_EVENTS_SQL}"""
)
def p28_rewrite(spark, sf_dir):
    """The rewritten events, taken apart again: the new leaf, and what stays as it was."""
    from ..operators.rewrite import rewritten

    at = lambda path: F.get_json_object("output", "$.hookSpecificOutput." + path)
    out = rewritten(_events(spark, sf_dir))
    return out.select("event_id", F.md5(at("updatedToolOutput.parts[0]")).alias("digest"), at("updatedToolOutput.parts[1]").alias("other"), at("updatedToolOutput.code").alias("code"), at("hookEventName").alias("hook"))


@query(f"SELECT key AS event_id, CASE WHEN seq % 5 = 0 THEN 'Grep' ELSE 'Bash' END AS tool, '/var/' || key AS path, p.n AS place, CASE WHEN p.n = 0 THEN {D.units('text')} ELSE 5 END AS size FROM ({S.logs_sql()}) l, (VALUES (0), (1)) AS p(n) WHERE l.seq % 5 <> 0")
def s01_event_leaves(spark, sf_dir):
    from ..operators.rewrite import leaves

    return leaves(_events(spark, sf_dir)).select("event_id", "tool", "path", F.col("at").alias("place"), text.units(F.col("text")).cast("long").alias("size"))


@query(f"SELECT handle, path AS source, 'Bash' AS tool, type AS content_type, {D.units('text0')} AS original_size, {D.units('s_text')} AS compressed_size, steps AS method, session AS session_id, CAST(1700000000000 AS BIGINT) AS created_at FROM {_EVENTS_SQL}")
def p29_ingest_metrics(spark, sf_dir):
    from ..operators.rewrite import tables

    return tables(_events(spark, sf_dir), 1_700_000_000_000)["metrics"]


@query(f"SELECT handle, {D.units('text0')} AS size, md5(text0) AS digest FROM {_EVENTS_SQL}")
def p29_ingest_originals(spark, sf_dir):
    from ..operators.rewrite import tables

    return tables(_events(spark, sf_dir), 1_700_000_000_000)["originals"].where("handle LIKE 'orig-%'").select("handle", "size", F.md5("content").alias("digest"))


def _sized(spark, sf_dir):
    return _originals(spark, sf_dir).withColumn("size", text.units(F.col("content")))


@query(f"""SELECT key AS handle, CASE WHEN {D.units('text')} > 60000 THEN 'refused' ELSE 'full' END AS mode, CASE WHEN {D.units('text')} > 60000 THEN CAST({D.units('text')} AS VARCHAR) || ' characters: ask by query or by lines' ELSE text END AS text, {D.units('text')} <= 60000 AS retrieved FROM ({S.LONG_SQL}) WHERE key IN ('src-src1-0', 'src-src2-0', 'src-src3-0')""")
def c23_retrieve_whole(spark, sf_dir):
    """Whole texts, or the refusal of one over the limit."""
    from functools import reduce

    from ..operators.api import retrieve

    originals = _sized(spark, sf_dir)
    return reduce(DataFrame.unionAll, [retrieve(originals, f"src-src{i}-0") for i in (1, 2, 3)] + [retrieve(originals, "none")]).select("handle", "mode", "text", "retrieved")


@query(f"SELECT handle, 'query' AS mode, line_no, '[line ' || line_no || '] ' || content AS text, true AS retrieved FROM (SELECT s.*, c.content FROM ({_SEARCH_SQL}) s JOIN {_CHUNKS_SQL} c USING (handle, line_no) WHERE handle = 'src-src1-0' ORDER BY rank, handle, line_no LIMIT 10)")
def f03_retrieve_by_keyword(spark, sf_dir):
    from ..operators.api import retrieve

    return retrieve(_sized(spark, sf_dir), "src-src1-0", query="Thing of.the")


@query(f"SELECT key AS handle, 'lines' AS mode, 5 AS line_no, array_to_string(({D.lines('text')})[5:7], chr(10)) AS text, true AS retrieved FROM ({S.LONG_SQL}) WHERE key = 'src-src2-0'")
def q01_retrieve_lines(spark, sf_dir):
    from ..operators.api import retrieve

    return retrieve(_sized(spark, sf_dir), "src-src2-0", start=5, number=3)
