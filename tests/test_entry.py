"""Queries against DuckDB, the API, and streaming ingestion."""

import json

import duckdb
import pytest

import __spark_entry__ as entry_module
from sifter.operators import api, metrics, store
from sifter.streaming.hook import ingest

SF = "/root/testdata/sf0.001"
TABLES = "events documents pages".split()
CHECKED = ["m0_saved_by_type", "p01_format_strip", "p05_snip", "p12_signature", "p17_ext_filter", "c05_signals", "c13_classify", "c14_quirks", "c16_digest", "p09_pipeline", "w03_chunks", "f01_search", "a01_summary", "a03_by_session", "g02_symbols", "g05_edges", "q05_diagnosis", "c13_classify_with_json", "p28_rewrite", "p29_ingest_metrics", "q02_stats", "a06_decisions_by_keyword", "a08_line_total", "q07_evaluation", "g10_symbol_card", "f03_retrieve_by_keyword"]


def cells(rows):
    plain = lambda x: round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(str, map(plain, r))) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry_module.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry_module.oracle_sql()[name]})").fetchall()
    assert cells(got.select(*columns).collect()) == cells(want)


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_metrics_of_an_empty_table(spark):
    empty = spark.createDataFrame([], store.METRICS)
    row = metrics.summary(empty).first()
    assert (row["total"], row["saved"], row["saved_ratio"]) == (0, 0, 0.0)


def test_metrics(spark):
    rows = [(1, "structured", 1000, 300, "x", "s"), (2, "structured", 2000, 800, "x", None), (3, "prose", 500, 500, "x", None), (4, "prose", 9, 1, "a-DEDUP", None), (5, "prose", 9, 1, None, None), (6, "prose", 100, 250, "x", "s")]
    table = spark.createDataFrame([(i, t, o, c, m, s, 0, i * 10, "Bash") for i, t, o, c, m, s in rows], "id BIGINT, content_type STRING, original_size BIGINT, compressed_size BIGINT, method STRING, session_id STRING, retrieved_count BIGINT, created_at BIGINT, tool STRING")
    s = metrics.summary(table.where("id < 6")).first()
    assert (s["total"], s["compressed"], s["saved"]) == (3, 2, 1900) and s["saved_ratio"] == pytest.approx(1900 / 3500)
    assert metrics.recent(table).first()["saved_pct"] == -150 and metrics.by_session(table).count() == 2


def test_retrieve(spark):
    text = "\n".join(["nothing"] * 50 + ["a 报错 here"] + ["tail"] * 49)
    rows = spark.createDataFrame([("h", text, len(text), 1), ("big", "x" * 60001, 60001, 1)], "handle STRING, content STRING, size BIGINT, created_at BIGINT")
    hit = api.retrieve(rows, "h", query="报错").collect()
    assert [r["line_no"] for r in hit] == [41]
    assert api.retrieve(rows, "h", query="absent").count() == 0 and api.retrieve(rows, "none").count() == 0
    assert api.retrieve(rows, "big").first()["mode"] == "refused" and api.retrieve(rows, "h").first()["retrieved"]
    assert api.retrieve(rows, None).first()["mode"] == "error"


def test_streaming_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    log = "\n".join(f"2024-01-01 00:00:{i % 60:02d} INFO step {i} went well enough" for i in range(200))
    event = {"tool_name": "Bash", "tool_input": {"file_path": "/var/x.log"}, "tool_response": {"out": [log, "short"], "n": 1}, "session_id": "s"}
    (source / "a.json").write_text("\n".join([json.dumps(event), json.dumps(event), "not json", json.dumps({"tool_name": "Grep", "tool_response": log})]))
    ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), 5).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out/rewritten")).collect()
    assert len(out) == 1
    response = json.loads(out[0]["output"])["hookSpecificOutput"]["updatedToolOutput"]
    assert response["n"] == 1 and response["out"][1] == "short" and "original kept as orig-" in response["out"][0]
    originals = {r["handle"]: r["content"] for r in spark.read.parquet(str(tmp_path / "out/originals")).collect()}
    assert log in originals.values() and all(h in response["out"][0] for h in originals)
    assert spark.read.parquet(str(tmp_path / "out/metrics")).count() == 1
