"""Folders, logs and the indexing job."""

import random

from pyspark.sql import functions as F

from sifter.functions import text as T
from sifter.operators import api, classify, codegraph, corpus, diagnosis, search, store
from sifter.sources import files


def test_walks_of_a_folder(spark, tmp_path):
    made = {
        "package.json": "{}", "src/main.ts": "export const a = 1;\n" * 5, "src/deep/x.ts": "let b;", "node_modules/m/i.js": "x", "README.md": "# Title\n" + "Some running text that is here to be read. " * 5,
        "notes.txt": "A note that is long enough to be more than fifty characters of text.", "blank.log": " \n\t \n", "data.bin": "\0\1\2" * 50, "tiny.txt": "x",
    }
    for name, body in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    root = str(tmp_path)
    assert {r["path"] for r in files.walk(spark, root, depth=2).collect()} == set(made) - {"node_modules/m/i.js"}
    assert {r["path"] for r in files.walk(spark, root, depth=1).collect()} == set(made) - {"node_modules/m/i.js", "src/deep/x.ts"}
    buckets = {r["path"]: r["bucket"] for r in files.corpus(spark, root).collect()}
    assert buckets["README.md"] == "observe" and buckets["notes.txt"] == "prose-candidate" and buckets["data.bin"] == "binary" and buckets["tiny.txt"] == "skip" and buckets["src/main.ts"] == "structured" and "node_modules/m/i.js" not in buckets
    assert "blank.log" not in {r["path"] for r in files.measured(spark, root).collect()}
    listing = files.walk(spark, root, depth=2).select(F.lit("p").alias("project"), "path", F.lit(1).alias("seq"))
    one = diagnosis.diagnose(listing).first()
    assert one["subtype"] == "node-bun" and one["code"] >= 2


def test_decision_log_counts_malformed_lines(spark, tmp_path):
    rows = spark.createDataFrame([("/a/stats.md", "Some text here.", "Bash", 3)], "path STRING, text STRING, tool STRING, ts BIGINT")
    made = corpus.decisions(classify.with_class(rows, "result"))
    files.write_decisions(made, str(tmp_path / "log"))
    files.write_decisions(made, str(tmp_path / "log"))
    (tmp_path / "log" / "more.json").write_text('{"type"\n\n[1]\n')
    total = files.decision_total(spark, str(tmp_path / "log")).first()
    assert (total["total"], total["records"]) == (4, 2)
    read = files.decision_log(spark, str(tmp_path / "log")).collect()
    assert len(read) == 2 and read[0]["nameKeywords"] == ["stats"] and read[0]["ext"] == ".md"


def test_evaluation_report(spark, tmp_path):
    rows = [("a.md", "observe", "prose"), ("b.md", "observe", "mixed"), ("c.ts", "structured", "structured"), ("d.ts", "structured", "prose"), ("e", "skip", "prose")]
    report = corpus.evaluation(spark.createDataFrame(rows, "path STRING, bucket STRING, type STRING"), spark.createDataFrame([("prose",), ("structured",), ("mixed",)], "type STRING"))
    corpus.write_report(report, str(tmp_path / "r"))
    got = {(r["section"], r["key"], r["type"] if "type" in r else None): (r["n"], r["share"]) for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert got["confusion", "structured", "prose"] == (1, 50.0) and got["observe", "md", "mixed"] == (1, 50.0) and got["prose", "blocks", "structured"] == (1, 33.3) and got["bucket", "skip", None] == (1, None)
    assert corpus.misjudged_prose(spark.createDataFrame([], "type STRING")).first()["rate"] == 0
    assert spark.range(1).select(T.percent(F.lit(1), F.lit(0))).first()[0] is None


def test_stages_are_evaluated_once(spark):
    """The plans hold each pattern once: a filter on a staged column doesn't bring its expression along."""
    rows = spark.createDataFrame([("a b", "t")], "text STRING, tool STRING")
    plan = classify.with_class(rows, "r").where("r.type = 'prose' AND r.confidence > 0.1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("because|although") == 1 and plan.count("FilterExec") <= 2
    chunks = spark.createDataFrame([("h", 1, "x")], "handle STRING, line_no INT, content STRING")
    plan = search.search(chunks, "one two.three")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2  # the counts and the totals, of which one exchange is read twice


def test_search_folds_texts_and_queries_alike(spark):
    texts = ["Příliš žluťoučký kůň", "Příliš žluťoučký kůň", "ÅNGSTRÖM file_name.ts", "한국어 텍스트", "报错 here", "", None]
    rows = spark.createDataFrame([("h", i, t) for i, t in enumerate(texts)], "handle STRING, line_no INT, content STRING")
    hits = lambda q: sorted(r["line_no"] for r in search.search(rows, q, limit=None).collect())
    assert hits("kůň") == hits("kun") == hits("KŮŇ") == [0, 1] and hits("angstrom") == [2] and hits("name.ts") == [2] and hits("ts.name") == [] and hits("텍스트") == [3] and hits("报错") == [4]
    assert search.search(rows, "!!").count() == 0


def made_project(n):
    """Files in a chain of imports, each with functions that call each other, and what the edges must be."""
    r = random.Random(11)
    rows, calls = [], set()
    for i in range(n):
        j = r.randrange(n)
        own = [f"import {{ f{j}x as g, f{j}y }} from './m{j}';"] + [f"export function f{i}x(a) {{", f"  return f{i}y(a) + g(a);", "}", f"function f{i}y(b) {{", f"  return f{j}y(b);" if j != i else "  return b;", "}"]
        rows.append((f"h{i}", f"/p/m{i}.ts", "\n".join(own) + "\n", 1))
        calls |= {(f"h{i}", f"f{i}x", f"h{i}", f"f{i}y", 3), (f"h{i}", f"f{i}x", f"h{j}", "g", 3)}
        if j != i:
            calls.add((f"h{i}", f"f{i}y", f"h{j}", f"f{j}y", 6))
    return rows, calls


def test_code_graph_of_thousands_of_files(spark):
    rows, calls = made_project(2000)
    originals = spark.createDataFrame(rows, "handle STRING, source STRING, content STRING, created_at BIGINT").repartition(4).cache()
    none_s, none_r = spark.createDataFrame([], store.SYMBOLS), spark.createDataFrame([], store.REFS)
    symbols, refs = codegraph.indexed(originals, none_s, none_r)
    symbols, refs = symbols.cache(), refs.cache()
    assert symbols.count() == 4000 and refs.where("ref_type = 'import' AND NOT resolved").count() == 0
    got = {(r["from_handle"], r["from_symbol"], r["to_handle"], r["to_symbol"], r["line"]) for r in refs.where("ref_type = 'call'").collect()}
    assert got == calls
    again = codegraph.indexed(originals.where("handle < 'h2'"), symbols, refs)
    assert again[0].count() == 4000 and again[1].count() == refs.count()
    changed = spark.createDataFrame([("h1", "/p/m1.ts", "export function only() {}\n", 2)], originals.schema)
    replaced = codegraph.indexed(changed, symbols, refs)
    assert [r["name"] for r in store.symbols_of(replaced[0], "h1").collect()] == ["only"] and replaced[1].where("from_handle = 'h1'").count() == 0
    assert store.has_symbols(symbols, "h1") and not store.has_symbols(symbols, "zz")
    asked = spark.createDataFrame([("h1",), ("h2",)], "handle STRING")
    lazy = codegraph.indexed(originals, symbols.where("handle = 'h1'"), refs.where("from_handle = 'h1'"), asked)
    assert {r["handle"] for r in lazy[0].select("handle").distinct().collect()} == {"h1", "h2"}
    card = codegraph.symbol_card(refs, symbols, "h5", "f5x").first()
    assert card["signature"] == "function f5x(a)" and [e["line"] for e in card["callees"]] == [3, 3]


def test_api_of_code(spark):
    rows, _ = made_project(6)
    originals = spark.createDataFrame(rows, "handle STRING, source STRING, content STRING, created_at BIGINT")
    assert [r["name"] for r in api.code_symbol(originals, "h3").collect()] == ["f3x", "f3y"] and [r["name"] for r in api.code_symbol(originals, "h3", symbol="f3y").collect()] == ["f3y"]
    assert api.code_refs(originals, "h3", "f3x").count() == 2
