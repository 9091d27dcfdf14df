"""Queries over documents with empty, blank and absent texts, as the tables hold them rarely, against their SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from caselake.operators import embed
from caselake.plans import registry
from caselake.sources import io

TEXTS = ["", " \n", None, "the agreement went on\nand on", "ent", " the cat sat. ", "...", "s" * 34 + "--- page 12 --- and more", "a" * 80 + "ent" + "b" * 80]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Forty times the texts, so that each comes under ids with every remainder that the queries use, and labels of some."""
    path = tmp_path_factory.mktemp("empty")
    rows = [(i, TEXTS[i // 40], "en", f"src{i % 5}", None if TEXTS[i // 40] is None else len(TEXTS[i // 40])) for i in range(40 * len(TEXTS))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, len(rows), 3)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shown(rows):
    return sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else str(x) for x in r) for r in rows)


def compare(spark, folder, name):
    got = registry.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as from '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({registry.ORACLES[name]})").fetchall()
    assert shown(map(tuple, got.collect())) == shown(want)


def test_make_snippet(spark, folder):
    compare(spark, folder, "make_snippet")


def test_read_case_texts(spark, folder):
    compare(spark, folder, "read_case_texts")


def test_empty_files_are_no_missing_ones(spark, tmp_path):
    """In the folder and below it; what is absent, hidden or of another kind stays missing."""
    (tmp_path / "in" / "x" / "y").mkdir(parents=True)
    for name, text in (("a.txt", "a"), ("b.txt", ""), ("x/c.txt", ""), ("x/y/d.txt", "d"), ("_e.txt", ""), ("f.md", ""), ("../h.txt", "")):
        (tmp_path / "in" / name).write_text(text)
    paths = ["/out/a.txt", "/out/b.txt", "out/x/c.txt", "d.txt", "_e.txt", "f.md", "x/g.txt", "x", "x/../b.txt", "../h.txt", "", None]
    cases = spark.createDataFrame(list(enumerate(paths)), "case_id long, text_path string")
    got = {r.case_id: (r.text, r.failure) for r in io.read_case_texts(spark, str(tmp_path / "in"), cases).collect()}
    gone = (None, "missing_file")
    assert [got[k] for k in range(len(paths))] == [("a", None), ("", None), ("", None), ("d", None), *[gone] * 4, ("", None), gone, gone, gone]


def test_embed_with_encoder(spark, folder):
    compare(spark, folder, "embed_with_encoder")


def test_encoded_numbers_are_rounded_from_doubles(spark, tmp_path):
    """A text of 291 characters, 16 e and 13 a: 0.99749998..., of which the float lies above the half."""
    text = "e" * 16 + "a" * 13 + "x" * 262
    assert float(np.float32(291 / math.sqrt(291**2 + 16**2 + 13**2))) > 0.9975
    spark.createDataFrame([(1, text, "en", "src1", 291)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    compare(spark, str(tmp_path), "embed_with_encoder")


def test_blank_texts_are_encoded_on_demand(spark):
    docs = spark.createDataFrame([(1, "  "), (2, None)], "i long, t string")
    load = lambda: lambda texts: [[float(len(t)), 0.0] for t in texts]
    norms = lambda **k: [r.norm for r in embed.embed_with_encoder(docs, "t", ["i"], load, 2, **k).orderBy("i").collect()]
    assert norms() == [0, 0] and norms(blank=True) == [2, 0]


def test_flatten_record(spark, folder):
    compare(spark, folder, "flatten_record")


def test_a_count_of_zero_stays(spark):
    """The second count holds as it is where the first one is zero or absent."""
    counts = "struct<raw_text_chars:int,normalized_text_chars:int,page_count:int>"
    given = [(k, (a,) * 3 if a != "x" else None, (b,) * 3 if b != "x" else None) for k, (a, b) in enumerate([(0, 9), (7, 9), (None, 0), (0, 0), ("x", 0), (0, "x"), (0, None)])]
    made = spark.createDataFrame(given, f"k int, text {counts}, text_extraction {counts}")
    others = [f.name for f in io.RECORD.fields if f.name not in ("text", "text_extraction")]
    records = made.select(F.col("k").cast("string").alias("case_number"), "text", "text_extraction", *(F.lit(None).cast(io.RECORD[n].dataType).alias(n) for n in others if n != "case_number"))
    got = {int(r.case_number): r for r in io.flatten_record(records).collect()}
    assert [got[k].raw_text_chars for k in range(7)] == [got[k].page_count for k in range(7)] == [9, 7, 0, 0, 0, None, None]


def test_evidence_grounding(spark, folder):
    compare(spark, folder, "evidence_grounding")
