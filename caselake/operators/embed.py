"""Embeddings: hashing vectors, pluggable encoders, checks and resumable builds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


#: Elements of the vectors that a task makes together.
CELLS = 1 << 21


def token_buckets(names: np.ndarray, dims: int) -> np.ndarray:
    """The bucket of each token: the first eight bytes of its BLAKE2b hash, little-endian, modulo dims."""
    digests = b"".join(hashlib.blake2b(str(t).encode(), digest_size=8).digest() for t in names)
    return (np.frombuffer(digests, "<u8") % np.uint64(dims)).astype(np.int64)


def hash_vectors(lists: list, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of many token lists, their norms before scaling, and their numbers of distinct tokens.

    Every distinct token of the lists is hashed once; a token found c times adds 1 + ln c to its bucket.
    """
    n = len(lists)
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    code, names = pd.factorize(np.concatenate([np.asarray(x, dtype=object) for x in lists]) if len(row) else np.zeros(0, object))
    cell, counts = np.unique(row * max(1, len(names)) + code, return_counts=True)
    row, code = np.divmod(cell, max(1, len(names)))
    made = np.bincount(row * dims + token_buckets(names, dims)[code], 1.0 + np.log(counts), n * dims).reshape(n, dims) if len(row) else np.zeros((n, dims))
    norm = np.sqrt((made * made).sum(axis=1))
    return made / np.where(norm > 0, norm, 1.0)[:, None], norm, np.bincount(row, minlength=n)


def hash_embed(df: DataFrame, text: str, keep: list[str], dims: int = 384) -> DataFrame:
    """`keep`, vector array<float>, norm and token_count; tokens are made by Spark, hashing by batch."""
    if dims <= 0:
        raise ValueError("dims must be positive")
    rows = df.select(*keep, T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("__tokens"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "vector array<float>, norm double, token_count int"])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, CELLS // dims)
        for whole in it:
            for i in range(0, len(whole), step):
                pdf = whole.iloc[i : i + step].copy()
                vector, norm, count = hash_vectors(pdf.pop("__tokens").tolist(), dims)
                yield pdf.assign(vector=list(vector.astype(np.float32)), norm=norm, token_count=count)

    return rows.mapInPandas(batches, schema)


def hash_embed_native(df: DataFrame, text: str, keep: list[str], dims: int = 384) -> DataFrame:
    """The same idea with Spark's own hash, all in SQL: (keep, bucket, value) of the unit vectors' non-zero buckets."""
    counted = df.select(*keep, F.explode(T.tokens(F.coalesce(F.col(text), F.lit("")))).alias("t")).groupBy(*keep, "t").agg((1 + F.log(F.count(F.lit(1)))).alias("w"))
    bucketed = counted.groupBy(*keep, F.pmod(F.xxhash64("t"), F.lit(dims)).cast("int").alias("bucket")).agg(F.sum("w").alias("w"))
    norms = bucketed.groupBy(*keep).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return bucketed.join(norms, keep).select(*keep, "bucket", (F.col("w") / F.col("norm")).alias("value"))


def embed_with_encoder(df: DataFrame, text: str, keep: list[str], load: Callable[[], Callable[[list[str]], list]], dims: int, batch_size: int = 32, kind: str = "float", blank: bool = False) -> DataFrame:
    """`keep`, vector (an array of kind, float or double) and norm from an encoder that each worker loads once.

    Blank texts are zero vectors, or with blank they are encoded like others; an absent text counts as an empty one.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"vector array<{kind}>, norm double"])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for pdf in it:
            texts = [t or "" for t in pdf.pop("__text")]
            out = np.zeros((len(texts), dims))
            full = [k for k, t in enumerate(texts) if blank or t.strip()]
            for i in range(0, len(full), batch_size):
                part = full[i : i + batch_size]
                encoder = encoder or load()
                made = np.asarray(encoder([texts[k] for k in part]), dtype=float)
                if made.shape != (len(part), dims):
                    raise ValueError(f"the encoder returned {made.shape} for {len(part)} texts of {dims} dimensions")
                out[part] = made
            norm = np.sqrt((out * out).sum(axis=1))
            unit = np.divide(out, norm[:, None], out=out.copy(), where=norm[:, None] > 0)
            yield pdf.assign(vector=list(unit.astype(np.float32 if kind == "float" else float)), norm=norm)

    return rows.mapInPandas(batches, schema)


def pack_vectors(vector: Column) -> Column:
    """array<float> as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v, "<f4").tobytes() for v in vectors], dtype=object)

    return pack(vector)


def unpack_vectors(blob: Column, dims: Column) -> Column:
    """The floats of a packed vector; a size other than dims * 4 is an error."""

    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for b, n in zip(blobs, sizes, strict=True):
            if b is not None and len(b) != 4 * n:
                raise ValueError(f"a vector of {len(b)} bytes isn't one of {n} dimensions")
            out.append(None if b is None else np.frombuffer(b, "<f4"))
        return pd.Series(out, dtype=object)

    return unpack(blob, dims)


def validate_embeddings(df: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, violation) of vectors with a wrong size or non-finite values, of bad norms and token counts."""
    odd = lambda x: F.isnan(x) | (F.abs(x) == math.inf)
    tests = [
        ("dims", F.coalesce(F.size("vector") != dims, F.lit(True))),
        ("non_finite", F.coalesce(F.exists("vector", odd), F.lit(False))),
        ("norm", F.coalesce(odd(F.col("norm")) | (F.col("norm") < 0), F.lit(True))),
        ("token_count", F.coalesce(F.col("token_count") < 0, F.lit(True))),
    ]
    return df.select(key, F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))).alias("violation"))


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """Chunks without a vector of the model, in (case_id, chunk_index) order."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    left = chunks.join(embeddings.where(F.col("embedding_model") == model), "chunk_id", "left_anti")
    return left if limit is None else left.orderBy("case_id", "chunk_index").limit(limit)


def build_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str, dims: int = 384, resume: bool = True) -> tuple[DataFrame, DataFrame]:
    """(all rows of the model after the build, chunks that have no usable text)."""
    todo = missing_embeddings(chunks, embeddings, model) if resume else chunks
    made = hash_embed(todo, "chunk_text", ["chunk_id"], dims).withColumn("embedding_model", F.lit(model)).withColumn("dims", F.lit(dims))
    usable = (F.col("norm") > 0) & (F.col("token_count") > 0)
    kept = embeddings.where(F.col("embedding_model") == model) if resume else embeddings.limit(0)
    return kept.unionByName(made.where(usable).select(*embeddings.columns)), made.where(~usable).select("chunk_id")


def case_centroids(embeddings: DataFrame, case: str = "case_id", vector: str = "vector") -> DataFrame:
    """(case, centroid): the sum of a case's vectors scaled to length one; a zero sum stays."""
    each = embeddings.select(case, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    sums = each.groupBy(case, "i").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy(case).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn("__n", norm).select(case, F.transform("v", lambda x: F.when(F.col("__n") > 0, x / F.col("__n")).otherwise(x)).alias("centroid"))
