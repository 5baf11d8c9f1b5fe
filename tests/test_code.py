"""The scanner and the code graph."""

from sifter.functions.paths import import_candidates
from sifter.functions.scanner import scan
from sifter.operators import api, codegraph
from sifter.plans.queries import _FILES

SOURCE = """import { foo, bar as baz } from "./lib";
import "./side";
export async function doWork<T>(a: T, b = foo(1)): Promise<void> {
  // foo(2) in a comment
  await this.run(`t ${foo(b)} y`);
  obj.method(a).chain(b);
  new Thing(foo);
  if (a) { return bar(); }
}
class Worker extends Base {
  constructor(private a: string) { super(a); }
  static async process(items: string[]): Promise<Map<string, {a: number}>> {
    return this.helper(items);
  }
  helper(x) { return x.map((i) => foo(i)); }
}
export const handler = (e: Event) => {
  doWork(e);
};
const re = /foo(1)"'/g;
interface I { m(): void }
"""


def test_scan():
    definitions, imports, calls = scan(SOURCE)
    assert [(d.name, d.kind, d.start_line, d.end_line, d.exported) for d in definitions] == [
        ("doWork", "function", 3, 9, True), ("Worker", "class", 10, 16, False), ("constructor", "method", 11, 11, False), ("process", "method", 12, 14, False), ("helper", "method", 15, 15, False), ("handler", "variable", 17, 19, True),
    ]
    assert [(i.names, i.source, i.line) for i in imports] == [(["foo", "bar", "baz"], "./lib", 1), ([], "./side", 2)]
    assert [(c.callee, c.caller) for c in calls] == [
        ("foo", "doWork"), ("run", "doWork"), ("foo", "doWork"), ("obj.method", "doWork"), ("obj.method(a).chain", "doWork"), ("bar", "doWork"), ("super", "constructor"), ("helper", "process"), ("x.map", "helper"), ("foo", "helper"), ("doWork", "handler"),
    ]


def test_scan_survives_anything():
    for text in ("", "}{)(", "`${`${", "'", "/*", "function", "class {", "const x = ", "import", "a(" * 300, SOURCE[:200]):
        scan(text)


def test_candidates():
    got = import_candidates("/p/src/a.ts", "../lib/c")
    assert len(got) == 17 and got[:2] == ["/p/lib/c", "/p/lib/c.ts"] and got[9] == "/p/lib/c/index.ts"
    assert import_candidates("/p/a.ts", "react") == [] and import_candidates(None, "./x") == []


def test_graph(spark):
    originals = spark.createDataFrame(_FILES, "handle STRING, source STRING, content STRING, created_at BIGINT")
    files = codegraph.parsed(originals)
    refs, table = codegraph.edges(files, originals), codegraph.symbols(files)
    assert codegraph.call_tree(refs, table, "h1", "run", 3)[0].startswith("foo (line 5) [cross file]")
    early = codegraph.edges(files, originals, as_of=True).where("from_handle = 'h1' AND to_symbol = 'foo' AND ref_type = 'call'").first()
    assert early["to_handle"] is None and early["import_src"] == "./b"
    assert [r["name"] for r in api.code_symbol(originals, "h2", query="O").collect()] == ["foo", "Box", "open", "close"]
    assert {r["from_symbol"] for r in api.code_refs(originals, "h2", "bar", "callers").collect()} == {"foo", "close"}
