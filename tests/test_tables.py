import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselake.operators import cases as C
from caselake.operators import embed, evaluate, quality, search, similar, stats
from caselake.sources import io
from caselake.streaming import ingest


def test_metadata_files(spark, tmp_path):
    record = lambda n, y, **k: {"case_number": n, "decision_date": "114.01.02", "dispute_type": {"label": "手術認定"}, "crawl_batch": {"roc_year": y}, "local_files": {"normalized_text_path": f"/x/{n}.txt"}, "text": {"raw_text_chars": 0}, "text_extraction": {"raw_text_chars": 9}} | k
    (tmp_path / "a_metadata.json").write_text(json.dumps({"records": [record("114-1", 114)]}, indent=1))
    (tmp_path / "b_metadata.json").write_text(json.dumps({"records": [record("115-1", None, query={"roc_year": 115}), record("", None)]}))
    (tmp_path / "c_report.json").write_text("{}")
    rows = io.flatten_record(io.read_case_metadata(spark, [str(tmp_path)] * 2)).orderBy("case_number").collect()
    assert [(r.case_number, r.roc_year, r.failure, r.raw_text_chars) for r in rows] == [("", None, "missing_case_number", 9), ("114-1", 114, None, 9), ("115-1", 115, None, 9)]
    (tmp_path / "d_metadata.json").write_text('{"records": 3}')
    with pytest.raises(Exception):
        io.read_case_metadata(spark, [str(tmp_path)]).collect()
    (tmp_path / "114-1.txt").write_text("內容\n", encoding="utf-8")
    cases = spark.createDataFrame([("a", "/x/114-1.txt"), ("b", "/x/none.txt")], "case_id string, text_path string")
    assert sorted((r.case_id, r.text, r.failure) for r in io.read_case_texts(spark, str(tmp_path), cases).collect()) == [("a", "內容\n", None), ("b", None, "missing_file")]


def test_pdf_text(spark):
    def bad(data):
        raise ValueError("broken")

    files = spark.createDataFrame([("a", b"one|two"), ("b", b"")], "path string, content binary")
    got = {r.path: r for r in io.pdf_text_extract(files, [("first", bad), ("second", lambda d: d.decode().split("|"))]).collect()}
    assert (got["a"].text, got["a"].page_count, got["a"].method) == ("--- page 1 ---\none\n\n--- page 2 ---\ntwo", 2, "second")
    assert got["b"].failure == "first: broken; second: no text"


def test_listing_pages(spark):
    row = "<tr><td>{0}</td><td><a href='get?article=x{0}'>N{0}</a></td><td>115.01.0{0}</td><td>t</td></tr><tr><td colspan=4>sum {0}</td></tr>"
    html = ["共 2 筆<table>" + row.format(1) + row.format(2) + "</table>", "<p>查無資料</p>", "共 5000 筆", "共 3 筆<table>" + row.format(1) + "</table>", None]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = {r.page_id: r for r in io.parse_listing_pages(pages).collect()}
    assert [got[k].status for k in range(5)] == ["ok", "no_results", "needs_split", "partial", "ok"]
    assert [(x.position, x.case_number, x.link, x.summary) for x in got[0].records] == [(1, "N1", "get?article=x1", "sum 1"), (2, "N2", "get?article=x2", "sum 2")]


def test_lake_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 114, "a/b", None), (2, 115, None, "bad")], "case_id long, roc_year int, dispute_type string, failure string")
    io.write_case_lake(df, str(tmp_path / "lake"))
    assert (tmp_path / "lake" / "roc_year=114" / "dispute_type_part=a_b").is_dir()
    got = io.report(df, "failure", ["case_id"]).first()
    assert (got.total, got.failed, got.samples) == (2, 1, ['{"case_id":2,"failure":"bad"}'])


def test_upsert_keeps_created_at_and_takes_nulls(spark):
    old = spark.createDataFrame([(1, "x", "then"), (2, "y", "then")], "k long, v string, created_at string")
    new = spark.createDataFrame([(1, None, "now"), (3, "z", "now")], "k long, v string, created_at string")
    assert sorted(map(tuple, C.upsert(old, new, "k").collect())) == [(1, None, "then"), (2, "y", "then"), (3, "z", "now")]


def test_stream_ingest(spark, tmp_path):
    schema = "k long, v string, created_at string"
    state = {"df": spark.createDataFrame([(1, "x", "then")], schema)}
    spark.createDataFrame([(1, "n", "now"), (2, "m", "now")], schema).write.json(str(tmp_path / "in"))

    def write(df, number):
        df.write.parquet(str(tmp_path / f"out{number}"))
        state["df"] = spark.read.parquet(str(tmp_path / f"out{number}"))

    query = ingest.ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), lambda: state["df"], write, "k", "created_at", str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sorted(map(tuple, state["df"].collect())) == [(1, "n", "then"), (2, "m", "now")]


def test_versions(spark):
    columns = "summary_id string, case_id string, model string, prompt_version string, source_sha256 string, generated_at string, imported_at string, review_status string, reviewer string, review_note string, reviewed_at string"
    cases = spark.createDataFrame([("c",)], "case_id string")
    new = lambda **k: spark.createDataFrame([("c", "m", "v1", k.get("sha", "a" * 64), k.get("at", "1"), "i", "unreviewed", None, None, None, k.get("failed", 0), False)], columns.replace("summary_id string, ", "") + ", failed_request_count int, final_merge_fallback boolean")
    none = spark.createDataFrame([], columns)
    merged, counts, _ = C.import_summaries(none, new(), cases)
    assert tuple(counts.first()) == (1, 0)
    reviewed = C.apply_reviews(merged, merged.select("summary_id", F.lit("approved").alias("status"), F.lit("ann").alias("new_reviewer"), F.lit(None).cast("string").alias("new_note")), F.lit("t"))
    again, counts, rejected = C.import_summaries(reviewed, new(at="2").unionByName(new(sha="zz")).unionByName(new(failed=1, sha="b" * 64)), cases)
    row = again.first()
    assert tuple(counts.first()) == (0, 1) and (row.review_status, row.reviewer, row.generated_at) == ("approved", "ann", "2")
    assert sorted(r.reason for r in rejected.collect()) == ["bad_source_hash", "failed_requests"]
    newer, _, _ = C.import_summaries(again, new(sha="c" * 64, at="9"), cases)
    assert C.latest_summary(newer).first().official
    assert C.latest_summary(newer.withColumn("review_status", F.lit("rejected"))).count() == 0


def test_sample(spark):
    cases = spark.createDataFrame([("case_1", "a", 1500), ("case_2", "b", 1200), ("case_3", "c", 5000), ("case_4", "b", 3000), ("short", "d", 10)], "case_id string, dispute_type string, text_chars int")
    done = spark.createDataFrame([("case_1",)], "case_id string")
    assert [r.case_id for r in C.representative_sample(cases, done, 2).orderBy("pick").collect()] == ["case_2", "case_3"]
    assert C.representative_sample(cases, done, 10).count() == 3


def test_keyword_fallback_and_wildcards(spark):
    cases = spark.createDataFrame([(1, "N1", "114.01.01", "type", "契約之解除與退費"), (2, "N2", "114.01.02", "type", "other words here")], "case_id long, case_number string, decision_date string, dispute_type string, text string")
    queries = spark.createDataFrame([(1, "解除"), (2, "words other"), (3, "N1"), (4, "!")], "query_id long, query string")
    got = {(r.query_id, r.case_id, r.match_source) for r in search.keyword_search(cases, queries, "case_id", ["case_number", "dispute_type", "text"], "decision_date", "case_number").collect()}
    assert got == {(1, 1, "like_fallback_empty_fts5"), (2, 2, "fts5"), (3, 1, "fts5")}
    wild = spark.createDataFrame([(1, "w_rds")], "query_id long, query string")
    assert search.keyword_like(cases, wild, ["text"], ["case_id"], wildcards=True).count() == 1 and search.keyword_like(cases, wild, ["text"], ["case_id"]).count() == 0


def test_fusion(spark):
    cases = spark.createDataFrame([(1, "d", "a"), (2, "d", "b"), (3, "d", "c")], "case_id long, decision_date string, case_number string")
    keyword = spark.createDataFrame([(1, 1, 1, "fts5"), (1, 3, 2, "fts5")], "query_id long, case_id long, keyword_rank int, match_source string")
    semantic = spark.createDataFrame([(1, 2, 1, 0.9), (1, 1, 2, 0.8)], "query_id long, case_id long, semantic_rank int, similarity double")
    got = search.hybrid_search(keyword, semantic, cases).orderBy("rank").collect()
    assert [(r.case_id, r.match_type) for r in got] == [(1, "hybrid"), (2, "semantic"), (3, "keyword")]
    assert got[0].hybrid_score == round(2 / 62 + 1 / 61, 8)
    alone = search.hybrid_search(keyword, semantic.limit(0), cases).orderBy("rank").collect()
    assert [r.hybrid_score for r in alone] == [r.hybrid_score for r in search.keyword_only(keyword).orderBy("rank").collect()]
    ranking = search.hybrid_search(keyword, semantic, cases)
    up = [r.case_id for r in search.page_of_ranking(ranking, 1, 2, ascending=True).orderBy("position").collect()]
    assert up == [3, 2]


def test_embedding_jobs(spark):
    chunks = spark.createDataFrame([("a", "c", 0, "alpha beta beta"), ("b", "c", 1, " "), ("d", "c", 2, "癌症")], "chunk_id string, case_id string, chunk_index int, chunk_text string")
    empty = spark.createDataFrame([], "chunk_id string, embedding_model string, dims int, vector array<float>, norm double, token_count int")
    full, skipped = embed.build_embeddings(chunks, empty, "m", 4096, resume=False)
    half, _ = embed.build_embeddings(chunks.limit(1), empty, "m", 4096)
    resumed, _ = embed.build_embeddings(chunks, half, "m", 4096)
    key = lambda d: sorted((r.chunk_id, tuple(r.vector), r.token_count) for r in d.collect())
    assert key(full) == key(resumed) and [r.chunk_id for r in skipped.collect()] == ["b"]
    row = next(r for r in full.collect() if r.chunk_id == "a")
    assert math.isclose(row.norm, math.sqrt(1 + (1 + math.log(2)) ** 2)) and row.token_count == 2
    encoded = embed.embed_with_encoder(chunks, "chunk_text", ["chunk_id"], lambda: lambda texts: [[float(len(t)), 0.0, 3.0] for t in texts], 3, 2)
    got = {r.chunk_id: np.array(r.vector) for r in encoded.collect()}
    assert not got["b"].any() and math.isclose(float(got["a"] @ got["a"]), 1, rel_tol=1e-6)
    with pytest.raises(Exception):
        embed.embed_with_encoder(chunks, "chunk_text", ["chunk_id"], lambda: lambda texts: [[1.0]] * len(texts), 3).collect()


def test_native_hashing_makes_unit_vectors(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, "x")], "i long, t string")
    got = embed.hash_embed_native(docs, "t", ["i"], 16).groupBy("i").agg(F.sum(F.col("value") ** 2).alias("s")).collect()
    assert all(math.isclose(r.s, 1) for r in got)


def test_related_cases(spark):
    rows = [("source", "N1", "1", "cat", "r", "手術認定", "住院 手術"), ("case_same", "N2", "2", "cat", "r", "手術認定", "住院"), ("other", "N3", "3", None, "x", "其他", "無關"), ("far", "N4", "4", "", "", "", "手術")]
    df = spark.createDataFrame(rows, "case_id string, case_number string, decision_date string, decision_category string, decision_result string, dispute_type string, text string")
    got = similar.similar_cases_topk(similar.signatures(df, F.col("text")), df, 5).where("case_id = 'source'").orderBy("rank").collect()
    assert [(r.similar_id, r.score) for r in got] == [("case_same", 86.0), ("far", 6.0)]
    assert got[0].reasons[-1] == "terms:住院" and got[0].total_candidates == 2


def test_semantic_similar_single_equals_all(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k // 3, k % 3, [float(x) for x in rng.normal(size=4)]) for k in range(24)]
    e = spark.createDataFrame(rows, "chunk_id long, case_id long, chunk_index int, vector array<double>")
    cases = spark.createDataFrame([(k, "d", str(k)) for k in range(8)], "case_id long, decision_date string, case_number string")
    every = similar.semantic_similar(e, cases, cases)
    some = similar.semantic_similar(e, cases, cases.where("case_id = 2"))
    assert sorted(map(str, every.where("case_id = 2").collect())) == sorted(map(str, some.collect()))


def test_precision_and_kappa(spark):
    labels = ["relevant"] * 61 + ["partially_relevant"] * 9 + ["not_relevant"] * 5
    rows = [(f"q{k % 15}", k % 15, k // 15 + 1, f"c{k}", k, labels[k]) for k in range(75)]
    df = spark.createDataFrame(rows, "query string, query_no int, rank int, chunk_id string, case_id int, label string")
    got = evaluate.precision_at_k(df.drop("label"), df).first()
    assert (got.micro_strict, got.micro_lenient) == (0.8133, 0.9333)
    assert evaluate.validate_results(df, 5).count() == 0 and evaluate.annotation_mismatches(df, df).count() == 0
    same = evaluate.cohens_kappa(evaluate.confusion(df, df)).first()
    assert (same.agreement, same.kappa) == (1.0, 1.0)
    only = df.withColumn("label", F.lit("relevant"))
    assert evaluate.cohens_kappa(evaluate.confusion(only, only)).first().kappa is None
    small = df.limit(4)
    half = small.withColumn("label", F.when(F.col("rank") >= 0, F.lit("not_relevant")))
    assert evaluate.label_conflicts(small, half).count() == 4
    with pytest.raises(ValueError):
        evaluate.annotator_agreement(df.withColumn("annotator", F.lit("Ann ")), df.withColumn("annotator", F.lit("ann")))


def test_audits(spark):
    df = spark.createDataFrame([(1, "114年評字第1號", "ok"), (2, "Н114", "a�b")], "k long, case_number string, dispute_type string")
    assert {(r.k, r.field) for r in quality.mojibake_audit(df, "k", ["case_number", "dispute_type"]).collect()} == {(2, "case_number"), (2, "dispute_type")}
    rec = spark.createDataFrame([(1, "A", "d", "t", "https://h/1", "x", "ok"), (2, "A", None, "t", "ftp://h", " ", "partial")], "seq long, case_number string, decision_date string, dispute_type string, pdf_url string, case_directory string, batch_status string")
    got = sorted(r.violation for r in quality.metadata_audit(rec, "https://h/").collect())
    assert got == ["duplicate_case_number", "missing_case_directory", "missing_decision_date", "unresolved_batch", "url_prefix"]


def test_a_hot_type_is_several_files(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id AS case_id", "114 AS roc_year", "if(id % 10 = 0, concat('t', id % 3), 'hot') AS dispute_type", "sha2(cast(id AS string), 256) AS text")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        io.write_case_lake(df, str(tmp_path / "lake"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = lambda kind: len(list((tmp_path / "lake" / "roc_year=114" / f"dispute_type_part={kind}").glob("*.parquet")))
    assert files("hot") > 2 and min(files(f"t{k}") for k in range(3)) == 1
    assert spark.read.parquet(str(tmp_path / "lake")).count() == 20_000


def test_hashed_vectors_against_plain_python(spark, sf, monkeypatch):
    import hashlib
    import math
    import re

    monkeypatch.setattr(embed, "CELLS", 500)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id % 7 = 0")
    for r in embed.hash_embed(docs, "text", ["doc_id", "text"], 32).collect():
        words = re.findall(r"[a-z0-9_]{2,}", r.text.lower()) or re.findall(r"\S", r.text.lower())
        want = [0.0] * 32
        for w in set(words):
            bucket = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") % 32
            want[bucket] += 1 + math.log(words.count(w))
        norm = math.sqrt(sum(x * x for x in want))
        assert r.token_count == len(set(words)) and r.norm == pytest.approx(norm)
        assert r.vector == pytest.approx([x / norm if norm else 0.0 for x in want], abs=1e-6)


def test_counted_medians(spark):
    import statistics

    rows = [(n, "x" * k if k else None) for n, sizes in enumerate([[1, 2, 2, 9], [3], [0, 5, 7, 7, 7, 8]]) for k in sizes]
    for n in range(3):
        own = [r for r in rows if r[0] == n]
        got = stats.summary_field_stats(spark.createDataFrame([(v,) for _, v in own], "a string"), ["a"]).first()
        sizes = [len(v) for _, v in own if v]
        assert (got.filled, got.min_chars, got.median_chars, got.avg_chars, got.max_chars) == (len(sizes), min(sizes), statistics.median(sizes), round(sum(sizes) / len(sizes), 2), max(sizes))
    assert stats.summary_field_stats(spark.createDataFrame([(None,)], "a string"), ["a"]).first().filled == 0


def test_corpus_verify_reads_each_table_once(spark, tmp_path):
    from caselake.operators import quality

    def kept(rows, fields, name):
        spark.createDataFrame(rows, fields).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    cases = kept([(1,), (2,), (3,), (3,), (None,)], "case_id long", "cases")
    chunks = kept([(10, 1, 5), (11, 1, 3), (12, 9, None), (None, None, 7)], "chunk_id long, case_id long, chunk_chars int", "chunks")
    vectors = kept([(10, 4), (10, 4), (99, 5), (None, None)], "chunk_id long, dims int", "vectors")
    other = kept([(1,), (2,)], "x int", "other")
    made = quality.corpus_verify({"cases": (cases, 5), "vectors": (vectors, 3), "other": (other, 2)}, cases, chunks, vectors, 4)
    got = {r["check"]: (r.actual, r.expected, r.passed) for r in made.collect()}
    assert got == {
        "count_cases": (5, 5, True), "count_vectors": (4, 3, False), "count_other": (2, 2, True), "cases_without_chunks": (4, 0, False),
        "chunks_without_vectors": (3, 0, False), "shortest_chunk": (3, 4, False), "kinds_of_dims": (2, 1, False),
    }
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4
    none = quality.corpus_verify({"cases": (cases.limit(0), 0)}, cases.limit(0), chunks.limit(0), vectors.limit(0))
    assert [(r["check"], r.actual) for r in none.collect()] == [("count_cases", 0), ("cases_without_chunks", 0), ("chunks_without_vectors", 0), ("shortest_chunk", 0), ("kinds_of_dims", 0)]
