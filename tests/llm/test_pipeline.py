"""Every stage on odd rows, and the whole pipeline against plain loops."""

import hashlib
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sifter.llm import secrets
from sifter.llm._io import stored, table
from sifter.llm.queries import tokenizer_path

from test_operators import brute_links, edits

ODD = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score STRING, lang_pred INT, key STRING, block STRING, _row INT, _language_score INT, toxic STRING"
STAGE = dict(corpus_pipeline.STAGES)


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with the operators' own names."""
    real = "the quick brown fox jumps over the lazy dog and then the cat sat on the mat with the other cat"
    tail = ("s", 7, "own", 1, "k", "b", 2, 3, "t")
    rows = [(1, real, "en", *tail), (1, real, "en", *tail), (1, "una casa blanca y un perro negro en la calle de la ciudad", "es", *tail), (None, real, None, *tail), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return rows + [(2, "", "en", *tail), (3, " \n ", "es", *tail), (4, "x " * 700_000, "en", *tail), (5, real + " too", "en", *tail)] + [(10 + i, f"{real} number {i} " * 3, "en", *tail) for i in range(8)] + [(30 + i, f"una casa {i} y la calle de la ciudad con el perro negro y los otros gatos", "es", *tail) for i in range(8)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    items = [(1, "what is the capital of the country where the long river meets the cold northern sea"), (2, None), (3, ""), (4, "short one")]
    spark.createDataFrame(items, "item_id BIGINT, text STRING").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", list(STAGE))
def test_stage_on_odd_rows_and_on_none(spark, sf, name):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    out = STAGE[name](spark, docs, sf)
    got = out.collect()
    empty = STAGE[name](spark, spark.createDataFrame([], ODD), sf)
    assert empty.columns == out.columns and empty.count() == 0
    if name == "packing":
        assert sorted({str(r["doc_id"]) for r in got}) == sorted({str(r[0]) for r in rows})
        return
    assert out.columns == docs.columns
    plain = [tuple(r) for r in got]
    if name == "near_duplicates":
        texts = [r[1] for r in rows]
        _, root, _ = brute_links([t if not t or len(t) < 10_000 else "x x x x x x" for t in texts])
        assert len(plain) == len(set(plain)) and set(plain) <= set(rows)
        assert len([r for r in plain if r[0] in (1, 5, None) and r[1] and r[1].startswith("the")]) == 1 and (1, rows[2][1]) in {r[:2] for r in plain}
        assert {r[0] for r in plain if not (r[1] or "").strip()} == {None, 2, 3}
    elif name == "language":
        assert {r for r in rows if r[1] is None or not r[1].strip()}.isdisjoint(plain) and sorted(map(str, plain)) == sorted(str(r) for r in rows if r[1] and r[1].strip() and r in plain)
        assert sum(r == rows[0] for r in plain) in (0, 2)
    else:
        assert sorted(map(str, plain)) == sorted(str(r[:4] + (None if name == "secret_redaction" and r[1] is None else len(r[1]) if name == "secret_redaction" else r[4],) + r[5:]) for r in rows)


def test_decontamination_tells_rows_of_one_id_apart(spark, sf):
    bad = "So: What is the Capital of the country, where the long river meets the cold northern sea?"
    docs = spark.createDataFrame([(1, bad), (1, "clean"), (None, bad), (None, "clean too"), (2, None)], "doc_id BIGINT, text STRING")
    assert sorted(str(r["text"]) for r in STAGE["decontamination"](spark, docs, sf).collect()) == ["None", "clean", "clean too"]


def test_whole_pipeline_against_plain_loops(spark, tmp_path):
    """Language by what was planted, groups by all pairs, leaks by full alignment, secrets by the patterns, pieces by the tokenizer."""
    from tokenizers import Tokenizer

    r = random.Random(21)
    base = table(spark, "/root/testdata/sf0.01", "documents").where("length(text) BETWEEN 300 AND 900").orderBy("doc_id").limit(110).select("doc_id", "text", "lang").collect()
    rows = [(x["doc_id"], x["text"], x["lang"]) for x in base]
    item = "in which year did the seven sailors of the blue ship first see the island of glass"
    for k in range(6):
        words = rows[k][1].split()
        rows.append((5000 + k, " ".join(words[: len(words) - 1 - k % 2]), rows[k][2]))  # near copies
        rows.append((5100 + k, rows[20 + k][1] + " " + item.replace("blue", "blux" if k % 2 else "blue"), rows[20 + k][2]))
        rows.append((5200 + k, rows[40 + k][1] + f" password: hunter{k}hunter " + hashlib.md5(bytes([k])).hexdigest(), rows[40 + k][2]))
        rows.append((5300 + k, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(800)), None))
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = sorted(x for x in rows if x[0] < 5300 or x[0] >= 5400)
    _, root, _ = brute_links([t for _, t, _ in left])
    left = [x for i, x in enumerate(left) if root[i] == i]
    plain = lambda t: re.sub(r"[^a-z0-9\u0080-\uffff]", "", t.lower())
    unit = plain(item)
    left = [x for x in left if edits(unit, plain(x[1])) > int(min(0.08 * len(unit), (len(unit) - 8) / 8))]
    whole = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t, _ in left:
        spans = sorted((m.start(), m.end(), k) for k, rule in (("assign", secrets._ASSIGN), ("access", secrets._ACCESS), ("hex", secrets._HEX)) for m in rule.finditer(t) if k != "assign" or len(m[1]) >= 8)
        out, at = "", 0
        for a, b, k in spans:
            out, at = (out + t[at:a] + f"<{k.upper()}>", b) if a >= at else (out, max(at, b))
        want.append((i, len(whole.encode(out + t[at:], add_special_tokens=False).ids) + 1))
    assert sorted((x["doc_id"], x["length"]) for x in got) == sorted(want)


def test_stages_take_effect_and_keep_clean_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    junk = [(900_000 + i, " ".join(hashlib.sha256(bytes([i, j])).hexdigest() for j in range(30)), None, "s", 9) for i in range(5)]
    real = docs.count()
    docs = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    columns = docs.columns
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf))
        assert docs.columns == columns and docs.where(F.col("doc_id") >= 900_000).count() == 0
        counts.append(docs.count())
    assert counts[0] == real > counts[1] > counts[2] == counts[3]
    assert docs.where("text RLIKE '[0-9a-f]{32,}'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_language_stage_rejects_foreign_texts_and_junk(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    r = random.Random(7)
    say = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))
    foreign = [say(["prze", "szcz", "owie", "jest", "ych", "łą", "wsk", "dzi"], 150), say(["ств", "ого", "при", "ние", "ать", "ров"], 150), say(["kuu", "llä", "stä", "minen", "tta", "yhd"], 150)]
    junk = [" ".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(30)), "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900)), "for (int i = 0; i < rows.size(); ++i) { if (!ptr->mask(0x7f)) goto fail_lock; buf[i] ^= kQueue[i % 8]; }\n" * 4]
    halves = [max((x["text"] for x in docs.where(f"lang = '{lang}' AND length(text) < 3000").collect()), key=len)[:700] for lang in ("fr", "en")]
    short = [" ".join(halves), "Von.", "That it.", "Erinst resh.", "Des enberge die enver.", "Osrañ.", "Pachque çaneux et."]
    planted = [(1000000 + i, t, None) for i, t in enumerate([*foreign, *junk, *short])]
    got = {x["doc_id"] for x in corpus_pipeline.language(spark, docs.union(spark.createDataFrame(planted, docs.schema)), "").select("doc_id").collect()}
    bad = len(foreign) + len(junk)
    assert not got & set(range(1000000, 1000000 + bad))
    assert got >= set(range(1000000 + bad, 1000000 + bad + len(short))) | {x["doc_id"] for x in docs.select("doc_id").collect()}
