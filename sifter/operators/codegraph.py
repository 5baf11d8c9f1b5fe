"""Code graph: symbols and reference edges of TypeScript and JavaScript originals, and queries over them.

Edges are bound late: targets are looked up among all originals whenever edges are made, not frozen when a file is first read.
``as_of`` restricts the lookup to originals that existed by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.paths import import_candidates_column, language_of_source
from ..functions.scanner import scan
from ..functions.text import signature
from .store import latest_by_source

_S, _I = T.StringType(), T.IntegerType()


def _list(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


_PARSED = T.StructType([
    T.StructField("definitions", _list(name=_S, kind=_S, start_line=_I, end_line=_I, body_text=_S, exported=T.BooleanType())),
    T.StructField("imports", _list(names=T.ArrayType(_S), source=_S, line=_I)),
    T.StructField("calls", _list(callee=_S, caller=_S, line=_I)),
])


@F.udf(_PARSED, useArrow=True)
def _parse(text: str) -> dict:
    """Parsing has no built-in form; one pass gives all three lists."""
    definitions, imports, calls = scan(text or "")
    return {"definitions": [d._asdict() for d in definitions], "imports": [i._asdict() for i in imports], "calls": [c._asdict() for c in calls]}


def parsed(originals: DataFrame) -> DataFrame:
    """handle, source, lang, created_at and the three lists of every original in a known language."""
    code = originals.withColumn("lang", language_of_source(F.col("source"))).where(F.col("lang").isNotNull())
    return code.select("handle", "source", "lang", "created_at", _parse("content").alias("p")).select("handle", "source", "lang", "created_at", "p.*")


def symbols(files: DataFrame) -> DataFrame:
    rows = files.select("handle", "lang", "created_at", F.explode("definitions").alias("d"))
    return rows.select(
        "handle", "d.name", "d.kind", "d.start_line", "d.end_line", "d.body_text", signature(F.col("d.body_text")).alias("signature"), "d.exported", "lang", "created_at"
    )


def resolved_imports(files: DataFrame, originals: DataFrame, as_of: bool = False) -> DataFrame:
    """handle, n (of the import), names, source, line and to_handle: the first candidate path that was read, or NULL."""
    rows = files.select("handle", F.col("source").alias("importer"), F.col("created_at").alias("at"), F.posexplode("imports").alias("n", "i"))
    rows = rows.select("handle", "importer", "at", "n", F.col("i.names").alias("names"), F.col("i.source").alias("import_src"), F.col("i.line").alias("line"))
    paths = rows.select("handle", "n", "at", F.posexplode(import_candidates_column("importer", "import_src")).alias("rank", "path"))
    if as_of:
        known = originals.select(F.col("source").alias("path"), F.col("handle").alias("to_handle"), F.col("created_at").alias("there"))
        hits = paths.join(known, "path").where("there <= at").select("handle", "n", "rank", "to_handle", F.col("there").alias("there"))
    else:
        known = latest_by_source(originals).select(F.col("source").alias("path"), F.col("handle").alias("to_handle"), F.col("created_at").alias("there"))
        hits = paths.join(known, "path").select("handle", "n", "rank", "to_handle", "there")
    best = hits.groupBy("handle", "n").agg(F.min(F.struct("rank", (-F.col("there")).alias("age"), "to_handle")).alias("x")).select("handle", "n", F.col("x.to_handle").alias("to_handle"))
    return rows.join(best, ["handle", "n"], "left")


def edges(files: DataFrame, originals: DataFrame, as_of: bool = False) -> DataFrame:
    """Call and import edges. A plain callee is looked up among the file's own definitions, then among its imports, first import
    first; a member call stays unresolved."""
    imports = resolved_imports(files, originals, as_of)
    names = imports.select("handle", "n", "to_handle", "import_src", F.explode("names").alias("name"))
    first = names.groupBy("handle", "name").agg(F.min(F.struct("n", "to_handle", "import_src")).alias("i"))
    local = files.select("handle", F.explode("definitions.name").alias("name")).distinct().withColumn("local", F.lit(True))
    calls = files.select("handle", "created_at", F.explode("calls").alias("c")).select("handle", "created_at", F.col("c.callee").alias("name"), "c.caller", "c.line")
    target = calls.join(local, ["handle", "name"], "left").join(first, ["handle", "name"], "left")
    plain = ~F.contains("name", F.lit("."))
    own, named = plain & F.coalesce("local", F.lit(False)), plain & F.col("i").isNotNull()
    to = F.when(own, F.col("handle")).when(named, F.col("i.to_handle"))
    made = target.select(
        F.col("handle").alias("from_handle"), F.col("caller").alias("from_symbol"), to.alias("to_handle"), F.col("name").alias("to_symbol"), F.lit("call").alias("ref_type"), "line",
        to.isNotNull().alias("resolved"), F.when(~own & named, F.col("i.import_src")).alias("import_src"), "created_at",
    )
    each = F.explode(F.when(F.size("names") == 0, F.array(F.lit("(side-effect)"))).otherwise(F.col("names")))
    brought = imports.select(
        F.col("handle").alias("from_handle"), F.lit(None).cast("string").alias("from_symbol"), "to_handle", each.alias("to_symbol"), F.lit("import").alias("ref_type"), "line",
        F.col("to_handle").isNotNull().alias("resolved"), "import_src", F.col("at").alias("created_at"),
    )
    return made.unionByName(brought)


def indexed(originals: DataFrame, symbols_before: DataFrame, refs_before: DataFrame, handles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The code tables after indexing: originals in a known language are parsed and their rows replaced; running it twice changes nothing
    more. With ``handles`` (a column handle) only those, and only where no symbol of theirs is stored yet: indexing on demand, in which a
    file without a symbol is read again each time."""
    todo = originals
    if handles is not None:
        todo = originals.join(handles.select("handle").distinct(), "handle", "left_semi").join(symbols_before.select("handle").distinct(), "handle", "left_anti")
    files = parsed(todo)
    done = files.select("handle")
    new_symbols, new_refs = symbols(files), edges(files, originals)
    kept_symbols = symbols_before.join(done, "handle", "left_anti").select(*new_symbols.columns)
    kept_refs = refs_before.join(done.withColumnRenamed("handle", "from_handle"), "from_handle", "left_anti").select(*new_refs.columns)
    return kept_symbols.unionByName(new_symbols), kept_refs.unionByName(new_refs)


def find_symbol(table: DataFrame, handle: str, symbol: str) -> DataFrame:
    """The first definition of exactly this name, else all whose name contains it; a percent sign or underscore is a wildcard."""
    own = table.where(F.col("handle") == handle)
    exact = own.where(F.col("name") == symbol).orderBy("start_line", "end_line").limit(1)
    like = own.where(F.col("name").ilike(f"%{symbol}%"))
    none = like.join(exact.select(F.lit(1).alias("_one")).limit(1), how="left").where("_one IS NULL").drop("_one")
    return exact.unionByName(none).orderBy("start_line", "name")


def _sources(originals: DataFrame, handle: str, source: str) -> DataFrame:
    return originals.select(F.col("handle").alias(handle), F.col("source").alias(source))


def _first_symbols(table: DataFrame, handle: str, name: str) -> DataFrame:
    return table.groupBy("handle", "name").agg(F.min(F.struct("start_line", "signature")).alias("_s")).select(F.col("handle").alias(handle), F.col("name").alias(name), F.col("_s.signature").alias("signature"))


def callers(refs: DataFrame, table: DataFrame, originals: DataFrame, handle: str, symbol: str) -> DataFrame:
    """Who refers to a symbol: same-file and cross-file edges, with the caller's signature and file."""
    rows = refs.where((F.col("to_handle") == handle) & (F.col("to_symbol") == symbol))
    rows = rows.join(_first_symbols(table, "from_handle", "from_symbol"), ["from_handle", "from_symbol"], "left").join(_sources(originals, "from_handle", "source"), "from_handle", "left")
    state = F.when(F.col("from_handle") == handle, "same file").otherwise("cross file")
    return rows.select("from_handle", "from_symbol", "line", "ref_type", state.alias("state"), "source", "signature").orderBy("line", "from_handle")


def callees(refs: DataFrame, table: DataFrame, handle: str, symbol: str, depth: int = 1) -> DataFrame:
    """Edges that are reached from a symbol within ``depth`` calls (at most 3), each at its least level. Every level is one join
    from the distinct symbols first met in the level before, so cycles end and hubs aren't followed twice."""
    named = _first_symbols(table, "to_handle", "to_symbol")
    front = refs.sparkSession.createDataFrame([(handle, symbol)], "from_handle STRING, from_symbol STRING")
    seen, out = front, None
    for level in range(1, max(1, min(depth, P.MAX_DEPTH)) + 1):
        found = refs.join(front, ["from_handle", "from_symbol"]).withColumn("level", F.lit(level))
        out = found if out is None else out.unionByName(found)
        known = found.where("to_handle IS NOT NULL").select(F.col("to_handle").alias("from_handle"), F.col("to_symbol").alias("from_symbol")).distinct()
        front = known.join(seen, ["from_handle", "from_symbol"], "left_anti")
        seen = seen.unionByName(front)
    state = (
        F.when(F.col("to_handle") == F.col("from_handle"), "same file").when(F.col("to_handle").isNotNull(), "cross file").when(F.col("import_src").isNotNull(), "imported, unread")
        .when(F.contains("to_symbol", F.lit(".")), "member call").otherwise("unknown")
    )
    return out.join(named, ["to_handle", "to_symbol"], "left").select("level", "from_handle", "from_symbol", "to_handle", "to_symbol", "line", state.alias("state"), "import_src", "signature")


def call_tree(refs: DataFrame, table: DataFrame, handle: str, symbol: str, depth: int = 1) -> list[str]:
    """The callees as indented lines, depth first; a symbol shown before is named again but not opened. Only the edges within
    reach of the one symbol come to the driver."""
    rows = callees(refs, table, handle, symbol, depth).orderBy("line", "to_symbol").collect()
    by_source: dict[tuple[str, str], list] = {}
    for r in rows:
        by_source.setdefault((r["from_handle"], r["from_symbol"]), []).append(r)
    seen: set[tuple[str, str]] = set()

    def lines(at: tuple[str, str], level: int) -> list[str]:
        indent = "  " * (level - 1)
        if at in seen:
            return [f"{indent}{at[1]} (shown above)"]
        seen.add(at)
        out = []
        for r in by_source.get(at, []):
            out.append(f"{indent}{r['to_symbol']} (line {r['line']}) [{r['state']}]" + (f" {r['signature']}" if r["signature"] else "") + (f" from {r['import_src']}" if r["state"] == "imported, unread" else ""))
            if r["to_handle"] and r["signature"] is not None and level < min(depth, P.MAX_DEPTH):
                out += lines((r["to_handle"], r["to_symbol"]), level + 1)
        return out

    return lines((handle, symbol), 1)


def symbol_card(refs: DataFrame, table: DataFrame, handle: str, symbol: str) -> DataFrame:
    """One row: the first definition of the name with its callees and its callers in the file."""
    one = find_symbol(table, handle, symbol).limit(1)
    edge = F.sort_array(F.collect_list(F.struct("line", "other"))).alias("edges")
    out = refs.where((F.col("from_handle") == handle) & (F.col("ref_type") == "call")).select(F.col("from_symbol").alias("name"), "line", F.col("to_symbol").alias("other")).groupBy("name").agg(edge)
    into = refs.where((F.col("to_handle") == handle)).select(F.col("to_symbol").alias("name"), "line", F.col("from_symbol").alias("other")).groupBy("name").agg(edge)
    return one.join(out.withColumnRenamed("edges", "callees"), "name", "left").join(into.withColumnRenamed("edges", "callers"), "name", "left")
