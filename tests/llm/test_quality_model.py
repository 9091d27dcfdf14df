import re
import zlib

import numpy as np

from caselake.llm import quality_model as M
from caselake.llm.common import WORD


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in M.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    rows = [r for r in labels.collect() if r.doc_id in got]
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out == (r in test) for r in rows[:50])
    right = np.mean([got[r.doc_id].predicted == r.quality for r in test])
    bad = [got[r.doc_id].predicted == 0 for r in test if r.quality == 0]
    assert right > 0.95 and np.mean(bad) > 0.8
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) quality", "toxic")
    run = lambda x: sorted((r.doc_id, round(r.score, 9)) for r in M.classify(docs, x).collect())
    assert run(labels) == run(flipped)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b c " * 50_000, 1), (3, "a b", 1), (None, "x y", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (3, 1), (None, 1)], "doc_id long, quality int")
    got = M.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in M.classify(docs, labels.limit(0)).collect()] == [0.5] * 5
    assert M.classify(docs.limit(0), labels).collect() == []


def test_pooling():
    assert M.pooled(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0.25, 2])).tolist() == [0.0, 0.5, 0.5, 2.0]


def test_statistics_of_a_text():
    text = "Ab ab ab, cd! 12 #x\nab ab ab,"
    raw = text.encode()
    got = M.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    words = re.findall(WORD, text)
    assert np.isclose(got[0], np.log1p(len(words)))
    assert np.isclose(got[1], np.mean([len(w) for w in words]))
    assert np.isclose(got[3], sum(a == b for a, b in zip(words, words[1:])) / len(words))
    assert np.isclose(got[4], len(set(words)) / len(words))
    assert np.isclose(got[7], 1 / len(raw))


def test_fit_against_plain_numpy(spark):
    """Sums over partitions, ridge weights and the calibration curve, each computed again in one piece."""
    rng = np.random.default_rng(4)
    x = rng.normal(2, 3, (600, M.STATISTICS))
    x[:, 3] = 0.5  # a statistic that never varies
    y = (x[:, 0] + rng.normal(0, 1, 600) > 2).astype(float)
    settings = M.Settings(features=32, bins=64)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "statistics array<double>, target double").repartition(7)
    model = M.fit(df, settings)

    scale = x.std(axis=0)
    z = np.clip((x - x.mean(axis=0)) / np.where(scale > 1e-9, scale, 1), -M.CLIP, M.CLIP)
    gen = np.random.default_rng(settings.seed)
    direction, phase = gen.normal(0, 1 / settings.width, (M.STATISTICS, 32)), gen.uniform(0, 2 * np.pi, 32)
    f = np.hstack([np.sqrt(2 / 32) * np.cos(z @ direction + phase), np.ones((600, 1))])
    sums = M.normal_equations(df, model)
    assert np.allclose(sums[:, :-1], f.T @ f) and np.allclose(sums[:, -1], f.T @ y)
    # ridge as least squares over rows of zeros that hold the weights down
    weights = np.linalg.lstsq(np.vstack([f, np.sqrt(settings.ridge) * np.eye(33)]), np.concatenate([y, np.zeros(33)]), rcond=None)[0]
    assert np.allclose(model.weights, weights)
    # the isotonic curve is the largest least, over all blocks, of block means
    bins = np.clip((f @ weights + 0.5) / 2 * 64, 0, 63).astype(int)
    used = np.unique(bins)
    n, mean = np.array([(bins == b).sum() for b in used]), np.array([y[bins == b].mean() for b in used])
    block = lambda a, b: (n[a : b + 1] * mean[a : b + 1]).sum() / n[a : b + 1].sum()
    curve = [max(min(block(a, b) for b in range(k, len(used))) for a in range(k + 1)) for k in range(len(used))]
    assert np.allclose(model.curve[0], (used + 0.5) / 64 * 2 - 0.5) and np.allclose(model.curve[1], curve)


def test_cosines_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (40, M.STATISTICS))
    settings = M.Settings(features=20_000)
    f = M.Model(settings, np.zeros(M.STATISTICS), np.ones(M.STATISTICS)).cosines(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * settings.width**2))
    assert np.abs(f @ f.T - kernel).max() < 0.04
