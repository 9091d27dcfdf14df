import math

from caselake.plans import registry


def test_a_negative_sum_that_rounds_to_zero_keeps_its_sign(spark, tmp_path):
    """As the query's SQL rounds: the text of -0.0 differs from that of 0.0."""
    rows = [(0, [1.0, -1.0, -0.000003, 0.0], "x"), (5, [1.0, -1.0, 0.000003, 0.0], "x")]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.case_id: r for r in registry.QUERIES["case_centroid"](spark, str(tmp_path)).collect()}
    signs = lambda r: [math.copysign(1, x) for x in (*r["head"], r.total)]
    assert [got[k].total for k in (0, 1)] == [0, 0] and got[0]["head"][2] == 0
    assert signs(got[0]) == [1, -1, -1, 1, -1] and signs(got[1]) == [1, -1, 1, 1, 1]
