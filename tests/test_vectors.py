import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselake.operators import search, similar
from caselake.operators import vectors as V


def table(spark, n, dims=8, same=0, seed=1):
    """n vectors in twenty heaps, the first `same` of them alike."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, dims))[rng.integers(0, 20, n)] + rng.normal(size=(n, dims)) * 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:same] = x[0]
    rows = [(k, k // 4, k % 4, f"{100 + k % 7}", f"N{k // 4:05d}", [float(v) for v in x[k]]) for k in range(n)]
    schema = "chunk_id long, case_id long, chunk_index int, decision_date string, case_number string, vector array<double>"
    return spark.createDataFrame(rows, schema).repartition(6), x, rows


def asked(spark, x, ids):
    return spark.createDataFrame([(f"q{k}", [float(v) for v in x[k]]) for k in ids], "query_id string, vector array<double>")


def expected(x, rows, ids, limit):
    out = []
    for k in ids:
        score = x @ x[k]
        kept = [(-round(float(s), 4), [-ord(c) for c in r[3]], [-ord(c) for c in r[4]], r[2], r[0]) for s, r in zip(score, rows, strict=True) if s > 0]
        out += [(f"q{k}", i + 1, r[-1], -r[0]) for i, r in enumerate(sorted(kept)[:limit])]
    return sorted(out)


@pytest.mark.parametrize("same", [0, 300])
def test_first_results_with_and_without_a_layout(spark, same, monkeypatch):
    chunks, x, rows = table(spark, 900, same=same)
    ids, figures = [0, 5, 450, 777], []
    queries = asked(spark, x, ids)
    want = expected(x, rows, ids, 7)
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, search.cosine_topk(queries, chunks, 7).collect()), key=key) == want
    index = search.chunk_index(chunks, clusters=20, report=figures.append)
    assert sorted(map(tuple, search.cosine_topk(queries, chunks, 7, index=index).collect()), key=key) == want
    assert index.counts.sum() == 900 and figures[0]["skipped"] > 0.5 * figures[0]["pairs"]
    monkeypatch.setattr(V, "QUERY_BYTES", 100)  # a block for each query or two
    assert sorted(map(tuple, search.cosine_topk(queries, chunks, 7).collect()), key=key) == want
    assert sorted(map(tuple, search.cosine_topk(queries, chunks, 7, index=index).collect()), key=key) == want


def test_the_corpus_is_not_shuffled(spark):
    chunks, x, _ = table(spark, 400)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = V.dot_products(asked(spark, x, range(50)), chunks, "query_id", "chunk_id", best=3)
        assert "Exchange hashpartitioning" not in scored._jdf.queryExecution().executedPlan().toString()
        of = scored.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(of) > 1 and scored.count() <= 50 * 3 * len(of)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_task_gives_back_no_more_than_its_first(monkeypatch):
    """Many equal vectors, few results: candidates are sorted again and again."""
    monkeypatch.setattr(V, "HELD", 50)
    rng = np.random.default_rng(2)
    top = V.Top(3, V.Wanted(4, None, 4, False, (("d", False), ("id", True))))
    score = np.round(rng.random((3, 600)), 2)
    score[1] = 0.5
    d = [f"{v}" for v in rng.integers(0, 5, 600)]
    for i in range(0, 600, 30):
        a, b = np.nonzero(score[:, i : i + 30] >= top.floor[:, None])
        rows = pa.table({"id": list(range(i, i + 30)), "d": d[i : i + 30]}).take(pa.array(b))
        top.add(rows, a, score[:, i : i + 30][a, b])
        assert top.rows <= 50 + 90
    top.sort()
    (t,) = top.held
    for q in range(3):
        want = sorted(range(600), key=lambda k: (-score[q, k], [-ord(c) for c in d[k]], k))[:4]
        assert [i for i, o in zip(t["id"].to_pylist(), t["_q"].to_pylist(), strict=True) if o == q] == want


def test_rounding_is_sparks(spark):
    x = np.array([0.00005, 0.00015, -0.00005, 0.12345, 0.99995, 1.00005, -0.33335, 0.5, 2.675e-1])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 4)).collect()]
    assert V.rounded(x, 4).tolist() == want


def test_best_chunk_of_each_case(spark):
    chunks, x, rows = table(spark, 300, same=40)
    ids = [1, 200]
    for best in (None, 5):
        got = {}
        for r in search.best_chunks(asked(spark, x, ids), chunks, best, dated=True).collect():
            got.setdefault(r.query_id, {})[r.case_id] = (r.chunk_id, r.score)
        for k in ids:
            score = x @ x[k]
            first = sorted(got[f"q{k}"].items(), key=lambda x: -x[1][1])[:best]  # a case behind them may lack its best chunk
            for case, (chunk, s) in first:
                own = [r[0] for r in rows if r[1] == case]
                assert abs(s - score[own].max()) < 1e-12 and abs(score[chunk] - s) < 1e-12
            if best is None:
                assert len(got[f"q{k}"]) == 75
            else:
                best_of = sorted((score[c * 4 : c * 4 + 4].max() for c in range(75)), reverse=True)[:best]
                assert np.allclose(sorted((s for _, s in got[f"q{k}"].values()), reverse=True)[:best], best_of)


def test_a_case_with_most_chunks_is_dealt_out(spark):
    """One case holds 600 of 800 chunks; the result is that of plain loops."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 6))
    of = [0] * 600 + [1 + k // 5 for k in range(200)]
    rows = [(k, of[k], k, [float(v) for v in x[k]]) for k in range(800)]
    chunks = spark.createDataFrame(rows, "chunk_id long, case_id long, chunk_index int, vector array<double>").repartition(5)
    cases = spark.createDataFrame([(c, "1", f"N{c:03d}") for c in range(41)], "case_id long, decision_date string, case_number string")
    sources = cases.where("case_id in (0, 3, 40)").select("case_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.case_id, r["rank"]): (r.similar_id, r.similarity, r.chunk_ids, r.total) for r in similar.semantic_similar(chunks, cases, sources, 4, 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for source in (0, 3, 40):
        own = [k for k in range(800) if of[k] == source]
        c = x[own].sum(axis=0)
        score = x @ (c / np.linalg.norm(c))
        found = []
        for case in range(41):
            mine = sorted((-round(float(score[k]), 4), k) for k in range(800) if of[k] == case and score[k] > 0)
            if mine and case != source:
                found.append((mine[0][0], -case, case, [k for _, k in mine[:2]]))
        for rank, (s, _, case, ids) in enumerate(sorted(found)[:4], 1):
            assert got[source, rank] == (case, -s, ids, len(found))
