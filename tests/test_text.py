"""Text primitives, classification and compression on fixtures made here."""

import random

import pytest
from pyspark.sql import functions as F

from sifter.functions import text as T
from sifter.operators import classify, compress, store

JSON = "[" + ",\n".join('{"id": %d, "name": "item", "ok": true}' % i for i in range(200)) + "]"
LOG = "\n".join(f"2024-01-01 00:00:{i % 60:02d} {'ERROR' if i % 4 == 0 else 'WARN' if i % 4 == 1 else 'INFO'} request took {i} ms" for i in range(100))
RUNNER = "\n".join(["  ok test number %d passed in 3 ms" % i for i in range(200)] + ["✗ broken thing", "TypeError: x is not y", "    at run (a.js:3:7)", "  at main (a.js:9:1)"] + ["  ok extra %d" % i for i in range(160)] + ["12 passed"])
PROSE = "\n".join(["这是一个说明文档,因为我们需要它。", "所以在这里写下了所有的内容。", "如果不是这样,也可以看看别的。", "我们还有不少的事情,都在下面。", "但是这也是可以的,因此不必担心。", "虽然有点长,应该还是可以读的。", "他们的想法和我们的不同。"])
CODE = "\n".join(f"function f{i}(a, b) {{ const c = a + b; return {{ c }}; }}" for i in range(60))


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("json", JSON), ("log", LOG), ("runner", RUNNER), ("prose", PROSE), ("code", CODE), ("mixed", CODE + "\n" + PROSE), ("empty", ""), ("null", None), ("binary", "\0\1\2abc" * 20), ("long", "\n".join(f"line {i} of many" for i in range(500)))]
    return spark.createDataFrame(rows, "name STRING, text STRING").cache()


def test_types(samples):
    got = {r["name"]: r["r"] for r in classify.with_class(samples, "r").collect()}
    want = {"json": "structured", "log": "structured", "runner": "structured", "prose": "prose", "code": "structured", "mixed": "mixed", "empty": "empty", "null": "empty", "binary": "structured"}
    assert {k: got[k]["type"] for k in want} == want
    assert got["json"]["confidence"] == 1.0 and "json-valid" in got["json"]["signals"]
    assert got["binary"]["signals"] == ["binary"] and got["empty"]["confidence"] == 1.0


def test_path_comes_before_content(spark):
    rows = spark.createDataFrame([("prose text. " * 9, "a.yml"), ("prose text. " * 9, "kernel_log"), ("x", "a.md")], "text STRING, path STRING")
    got = [r["r"]["signals"] for r in classify.with_class(rows, "r").collect()]
    assert got[0] == ["ext:yml"] and got[1] == ["name:log"] and got[2] == []


def test_digest_and_gates(samples):
    got = {r["name"]: r["d"] for r in compress.with_digest(samples.where("text IS NOT NULL"), "text", "d").collect()}
    runner = got["runner"]
    assert runner["method"] == "structured-digest" and (runner["signals"], runner["fails"], runner["errors"]) == (5, 1, 1)
    assert "[L201] ✗ broken thing" in runner["text"] and len(runner["text"]) < len(RUNNER) / 2
    assert got["log"]["gate"] == "density" and got["code"]["gate"] == "symbols" and got["long"]["gate"] == "signals" and got["prose"]["gate"] == "lines"


def test_pipeline_round_trip_and_prose_safety(spark, samples):
    r = random.Random(42)
    alphabet = list("abcde \n\t") + ["\x1b[32m", "\x1b[0m", "重复", "token-xyz"]
    fuzz = [(f"f{i}", "".join(r.choice(alphabet) for _ in range(r.randint(1000, 5000)))) for i in range(20)]
    rows = samples.where("text IS NOT NULL").unionByName(spark.createDataFrame(fuzz, "name STRING, text STRING"))
    out = compress.with_compression(rows, "text", "c", minimum=0)
    got = out.select("name", "c", compress.round_trip_equal(F.col("text"), F.col("c.text"), F.col("c.snippets")).alias("same")).collect()
    assert all(x["same"] for x in got)
    assert next(x for x in got if x["name"] == "long")["c"]["steps"] == ["snip"]
    assert next(x for x in got if x["name"] == "runner")["c"]["compressed"]
    only = compress.with_compression(rows, "text", "c", digest=False, cut=False).select("c.steps").collect()
    assert all(s.startswith("format-strip") for x in only for s in x["steps"])


def test_units_count_utf16(spark):
    assert spark.range(1).select(T.units(F.lit("😀a"))).first()[0] == 3


def test_store(spark):
    content = "\n".join(f"line{i}" for i in range(100))
    rows = spark.createDataFrame([("h", content, 1), ("h", content + "\nnew", 2), ("e", "", 1)], "handle STRING, content STRING, created_at BIGINT")
    kept = store.upserted(rows)
    assert kept.where("handle = 'h'").first()["content"].endswith("new")
    parts = store.chunks(kept).orderBy("handle", "line_no").collect()
    assert [p["line_no"] for p in parts] == [1, 21, 41, 61, 81, 101]
    assert store.get_lines(kept, "h", 10, 2).first()["text"] == "line9\nline10" and store.get_lines(kept, "h", 500, 2).first()["text"] == ""
    assert store.evolved(spark.createDataFrame([("x",)], "handle STRING"), store.METRICS).columns[-1] == "created_at"
