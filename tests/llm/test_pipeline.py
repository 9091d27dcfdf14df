import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as P
from caselake.llm import mixing, quality_rules
from caselake.llm.common import written
from tests.llm import test_near_dedup, test_quality_rules


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    made = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs, made[name] = spark.read.parquet(str(tmp_path / str(k))), (docs, spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert docs.columns == columns
            assert docs.where("n_chars != char_length(text)").count() == 0

    given, kept = made["quality_rules"]
    rows = [tuple(r) for r in given.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = {r[0] for r in test_quality_rules.verdicts(rows, quality_rules.LineLimits()) if r[-1]}
    assert {r.doc_id for r in kept.collect()} == want

    given, kept = made["near_duplicates"]
    rows = [tuple(r) for r in given.select("doc_id", "text").collect()]
    want = {c for _, c in test_near_dedup.expected(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)

    given, kept = made["secret_scan"]
    before = {r.doc_id: r.text for r in given.collect()}
    after = {r.doc_id: r.text for r in kept.collect()}
    assert before.keys() == after.keys()
    for i, t in after.items():
        if t != before[i]:
            at = 0
            for piece in t.split("[SECRET]"):  # all but the masked strings stands as before
                at = before[i].index(piece, at) + len(piece)

    given, kept = made["source_mix"]
    place = {r.doc_id: (r.slot, r.offset) for r in mixing.mixed(given, P.TARGETS).collect()}
    files = sorted({r[0] for r in kept.select(F.col("_metadata.file_path")).collect()})
    order = [r.doc_id for f in files for r in spark.read.parquet(f).collect()]
    assert sorted(order) == sorted(after) and [place[i] for i in order] == sorted(place.values())

    given, ids = made["bpe_ids"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in ids.collect()}
    assert rows.keys() == after.keys()
    for i, r in rows.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(after[i], add_special_tokens=False).ids
        assert r.exact and r.n_tokens == len(r.ids) // 4
        assert (r.slot, r.offset) == place[i]


def test_run_is_registered(spark, sf):
    assert "pipeline" in __spark_entry__.queries()
    got = P.run(spark, sf)
    assert got.columns == ["doc_id", "source", "slot", "offset", "n_tokens", "ids", "exact"]
    assert got.where("not exact").count() == 0 and got.count() > 0


CLASH = "__text string, tag long, node long, key string, spans string, slot long, text_hash long, frequent string, __hash string, h long, n long, id long, batch long"


def test_stages_on_edge_rows(spark, sf):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table, and columns with clashing names."""
    extra = tuple(None if k % 2 else ("x" if t.split()[1] == "string" else 7) for k, t in enumerate(CLASH.split(", ")))
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(80))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, body(3), None, None, None), (4, body(4), "en", "s", 5), (4, body(4), "en", "s", 5), (5, body(4), "en", "s", 5), (6, " ".join(f"z{k}" for k in range(120_000)), "en", "s", 1), (7, body(7) + ' password="b7db7aa4a5fcc78305"', "en", None, 1)]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
    docs = spark.createDataFrame([r + extra for r in rows], schema)
    empty = docs.limit(0)
    for k, (_, stage) in enumerate(P.STAGES):
        docs, empty = stage(spark, docs, sf), stage(spark, empty, sf)
        if k < 4:
            assert docs.columns == empty.columns == [c.split()[0] for c in schema.split(", ")]
            docs, empty = written(docs, "t"), written(empty, "t")
        assert empty.count() == 0
        if k == 0:
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 4, 4, 5, 6, 7]
        if k == 1:
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 4, 6, 7]
        if k == 2:
            assert [r.text.endswith('password="[SECRET]"') for r in docs.where("doc_id = 7").collect()] == [True]
    got = docs.collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 4, 6, 7] and all(r.exact for r in got)
