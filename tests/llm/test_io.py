"""The shared folder, block tables and joins with hot keys."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sifter.llm import _blocks, _graph, _io


class Cluster:
    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"

        @staticmethod
        def getConf():  # noqa: N802
            return {}


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _io.shared_folder(Cluster)


def test_stored_tables_can_be_dropped(spark):
    out = _io.stored(spark.range(3))
    assert out.count() == 3 and os.path.isdir(out._sifter_path)
    _io.dropped(out)
    _io.dropped(spark.range(1))
    assert not os.path.isdir(out._sifter_path)


def test_counts_survive_packing():
    for values in ([], [0, 1, 254, 255, 256, 1 << 40], [7] * 1000):
        x = np.array(values, np.int64)
        assert _blocks.unpacked_counts(_blocks.packed_counts(x), len(x)).tolist() == values


def test_blocks_hold_every_text_in_order(spark, monkeypatch):
    monkeypatch.setattr(_blocks, "PART_BYTES", 1 << 20)
    texts = [("é" * (i % 50) + str(i)) if i % 7 else None for i in range(500)] + ["z" * 3_000_000, "", "end"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING").coalesce(1)
    table = _blocks.text_blocks(docs, 2 << 20, "doc_id")
    assert table.select("block").distinct().count() >= 2 and table.count() >= 3
    got = {}
    for (block,) in table.select("block").distinct().collect():
        _, parts, flat, of = _blocks.block_of(table.where(F.col("block") == block).toArrow())
        for i, a, b in zip(_blocks.listed(parts, "doc_id").to_pylist(), of[:-1], of[1:], strict=True):
            got[i] = flat[a:b].tobytes().decode()
    assert got == {i: t or "" for i, t in enumerate(texts)}


def test_spread_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(_graph, "ROWS", 5)
    left = spark.range(2000).select((F.col("id") % 97 * (F.col("id") % 3)).alias("k"), F.col("id").alias("v"))
    left = left.unionByName(spark.createDataFrame([(None, -1)], "k BIGINT, v BIGINT"))
    right = spark.range(150).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, _graph.spread_join(left, right, "k").collect())) == want
    strings = lambda d: d.withColumn("k", F.col("k").cast("string").cast("binary"))
    assert _graph.spread_join(strings(left), strings(right), "k").count() == len(want)


def test_components_of_a_star_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr(_graph, "ROWS", 3)
    edges = [(0, i) for i in range(1, 200)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 500)]
    got = {r["node"]: r["label"] for r in _graph.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {**{i: 0 for i in range(1, 200)}, **{301 + i: 300 for i in range(60)}}
