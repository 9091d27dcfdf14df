"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass over the texts makes STATISTICS numbers for each. Standardised and held within CLIP deviations of the mean, so
that one odd text can't lie outside all that was learnt from, they are projected to `features` cosines whose
dot products approximate a Gaussian kernel. Each partition of labelled rows sums its share of the normal equations, the
sums are added up as streams, and the driver solves one system of that fixed size. Labelled rows' raw scores are then
counted in `bins` equal bins, and pooling adjacent violators makes the calibration curve from these counts. All labelled
rows count; nothing is sampled.

Defined results: null and empty texts have statistics of zeros and are scored like others; a row without an id is scored
and never learnt from; several labels of an id are averaged; without any label every score is 0.5; repeated rows get
equal scores, and each counts where it is labelled; very long texts are measured whole; an empty table has no scores;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mapped, per_text, slices, text_bytes, word_hashes, written
from .quality_rules import SYMBOLS, repeated_words

STATISTICS = 14
CLIP = 6.0
LINE = 10


@dataclass(frozen=True)
class Settings:
    features: int = 256
    width: float = 3.0  # of the Gaussian kernel over standardised statistics
    ridge: float = 1.0
    bins: int = 1024
    seed: int = 7


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x STATISTICS) numbers from whole texts; shares are of words or bytes."""
    words = Words(data, offsets)
    hashes = word_hashes(words)[0]
    n = words.counts.astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    some = np.maximum(n, 1)
    length = words.end - words.start
    mean = per_text(length, words.first) / some
    square = per_text(length * length, words.first) / some
    ends = data[words.end - 1] if len(words.start) else np.zeros(0, np.uint8)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[words.first[:-1][words.counts > 0]] = False
    ordered = hashes.copy()
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        ordered[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    fresh[words.first[:-1][words.counts > 0]] = True
    upper = (data >= 65) & (data <= 90)
    letters = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    lines = per_text(data == LINE, offsets) + 1
    share = lambda mask: per_text(mask, offsets) / size
    return np.stack(
        [
            np.log1p(n),
            mean,
            np.sqrt(np.maximum(square - mean * mean, 0)),
            per_text(again, words.first) / some,
            per_text(fresh, words.first) / some,
            per_text(fresh, words.first) / np.maximum(some**0.8, 1),
            repeated_words(words) / some,
            share(SYMBOLS[data]),
            share((data == 33) | (data == 63)),
            per_text(upper, offsets) / np.maximum(per_text(letters, offsets), 1),
            share((data >= 48) & (data <= 57)),
            share(~letters & (data > 32)),
            per_text((ends == 46) | (ends == 44), words.first) / some,
            np.log1p(n / lines),
        ],
        axis=1,
    )


def with_statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep` and the statistics of each whole text."""
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "statistics array<double>"])

    def batches(it):
        for batch in it:
            data, offsets = text_bytes(batch.column(len(keep)))
            for i, j in slices(offsets):
                made = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, STATISTICS, dtype=np.int32)), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(keep)]), column], names=[*keep, "statistics"])

    return mapped(kept, batches, schema)


@dataclass
class Model:
    settings: Settings
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def cosines(self, statistics: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.settings.seed)
        d = self.settings.features
        direction = rng.normal(0, 1 / self.settings.width, (statistics.shape[1], d))
        phase = rng.uniform(0, 2 * np.pi, d)
        x = np.clip((statistics - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.sqrt(2 / d) * np.cos(x @ direction + phase), np.ones((len(x), 1))])

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return self.cosines(statistics) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        if self.weights is None or self.curve is None:
            return np.full(len(statistics), 0.5)
        return np.clip(np.interp(self.raw(statistics), *self.curve), 0, 1)


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def normal_equations(labelled: DataFrame, model: Model, target: str = "target") -> np.ndarray:
    """Sum of [z z', z y] over all rows: a matrix of features + 1 rows and one more column."""
    side = model.settings.features + 1

    def part(it):
        total = np.zeros((side, side + 1))
        for batch in it:
            z = model.cosines(_stack(batch.column(0)))
            total += z.T @ np.hstack([z, batch.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def added(it):  # a stream: one matrix is held, however many arrive
        total = np.zeros((side, side + 1))
        for batch in it:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_py()).reshape(side, side + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = labelled.select("statistics", F.col(target).cast("double")).mapInArrow(part, "sums binary")
    return sum((np.frombuffer(r.sums).reshape(side, side + 1) for r in sums.repartition(8).mapInArrow(added, "sums binary").collect()), np.zeros((side, side + 1)))


def pooled(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to `value` under the weights (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, v in zip(weight.tolist(), value.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from rows (statistics, target); target lies between 0 and 1."""
    columns = [F.col("statistics")[k] for k in range(STATISTICS)]
    moments = labelled.agg(F.count(F.lit(1)), *(f(c) for c in columns for f in (F.avg, F.stddev_pop))).first()
    if not moments[0]:
        return Model(settings, np.zeros(STATISTICS), np.ones(STATISTICS))
    scale = np.array(moments[2::2], float)
    model = Model(settings, np.array(moments[1::2], float), np.where(scale > 1e-9, scale, 1.0))
    sums = normal_equations(labelled, model)
    model.weights = np.linalg.solve(sums[:, :-1] + settings.ridge * np.eye(len(sums)), sums[:, -1])

    def binned(it):
        for batch in it:
            place = np.clip((model.raw(_stack(batch.column(0))) + 0.5) / 2 * settings.bins, 0, settings.bins - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], names=["bin", "target"])

    counts = labelled.select("statistics", F.col("target").cast("double")).mapInArrow(binned, "bin long, target double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("y")).orderBy("bin").collect()
    place = np.array([r.bin for r in counts], float)
    model.curve = ((place + 0.5) / settings.bins * 2 - 0.5, pooled(np.array([r.n for r in counts], float), np.array([r.y for r in counts], float)))
    return model


def scored(profiled: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep` and score of rows with statistics."""
    kept = profiled.select(*keep, "statistics")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "score double"])

    def batches(it):
        for batch in it:
            score = model.score(_stack(batch.column(len(keep)))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[*keep, "score"])

    return mapped(kept, batches, schema)


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of held-out ids are not looked at."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    profiled = written(with_statistics(rows, "text", ["doc_id"]), "statistics")
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & ~held_out("doc_id"))
    target = known.groupBy("doc_id").agg(F.avg("y").alias("target"))
    labelled = written(profiled.join(target, "doc_id").select("statistics", "target"), "labelled")
    model = fit(labelled, settings)
    made = scored(profiled, model, ["doc_id"])
    return made.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
