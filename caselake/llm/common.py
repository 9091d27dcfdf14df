"""What the operators share: shared-folder tables, batches of text as numpy arrays, word and phrase hashes."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy helpers look at together; one longer text is looked at alone.
SLICE_BYTES = 1 << 19

WORD = r"[^\x20\x09-\x0D]+"


#: Most bytes of a batch between Spark and a Python worker; Spark's default of 64 MB is held several times at once.
ARROW_BYTES = "8m"
ARROW_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ARROW_BYTES, so that long texts don't fill an executor."""
    spark.conf.set(ARROW_KEY, ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table of a registered query, whose result is read under the Arrow batches set here."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir); on local[...] one is set where there is none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_PASSING: contextvars.ContextVar[tuple | None] = contextvars.ContextVar("passing", default=None)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this module named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Tables written inside are deleted at the end, after an error too: what leaves the block must rest on lasting ones alone.

    A lasting table belongs to the block around this one, if there is one, and is deleted with that.
    """
    outer = _PASSING.get()
    token = _PASSING.set(([], outer))
    try:
        yield
    finally:
        paths, _ = _PASSING.get()
        _PASSING.reset(token)
        for path in paths:
            delete(spark, path)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df as a table in the shared folder: later reads neither repeat its work nor depend on an executor."""
    spark = df.sparkSession
    before = spark.conf.get(ARROW_KEY, None)
    small_batches(spark)
    path = shared_folder(spark, name)
    df.write.parquet(path)
    spark.conf.unset(ARROW_KEY) if before is None else spark.conf.set(ARROW_KEY, before)
    block = _PASSING.get()
    if lasting and block is not None:
        block = block[1]
    if block is not None:
        block[0].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system, since idle Python workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, batches, schema: str) -> DataFrame:
    """df.mapInArrow(batches, schema), whose tasks leave no memory behind."""

    def whole(it):
        yield from batches(it)
        release()

    return df.mapInArrow(whole, schema)


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all: a repeated task writes the same bytes under the same name."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{path}/{name}")


def get_file(folder: str, name: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        return f.read()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its row offsets; a null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words (runs without the six ASCII white-space characters) of consecutive texts.

    start, end: byte places; first: index of each text's first word, with the total at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        ink = ~SPACE[data]
        start, end = ink.copy(), ink.copy()
        start[1:] &= ~ink[:-1]
        end[:-1] &= ~ink[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        start[inner] = ink[inner]
        end[inner - 1] = ink[inner - 1]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def places(self) -> np.ndarray:
        """Each word's place in its own text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.counts)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the public SplitMix64 finaliser)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The first k bytes of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SHORT = 16
_LANES = np.array([[0xD6E8FEB86659FD93], [0xC2B2AE3D27D4EB4F]], np.uint64)


def word_hashes(words: Words) -> np.ndarray:
    """128-bit hashes of the words, as two rows of 64 bits.

    A word of up to 16 bytes is two integers, which are scrambled with its length; longer ones go through XXH3-128.
    """
    out = np.empty((2, len(words.start)), np.uint64)
    if not out.size:
        return out
    padded = np.concatenate([words.data, np.zeros(_SHORT, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    size = words.end - words.start
    head = eight[words.start] & _LOW[np.minimum(size, 8)]
    tail = eight[words.start + 8] & _LOW[np.clip(size - 8, 0, 8)]
    length = mix64(size.astype(np.uint64), 5)
    out[0] = mix64(mix64(head, 1) ^ (tail + length), 2)
    out[1] = mix64(mix64(tail, 3) ^ (head + length), 4)
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        whole = words.data.tobytes()
        digests = b"".join(xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(words.start[long].tolist(), words.end[long].tolist(), strict=True))
        out[:, long] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    return out


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of sequences from the hashes of their left and right parts, each row by itself.

    The scrambling at each step is not linear, so no pattern of words makes different sequences meet: two of n hashed
    sequences share one row's hash with a chance of about n**2 / 2**65, and both rows' with one of n**2 / 2**129.
    """
    return mix64(left * _LANES[: len(left)] + right, 100)


def phrase_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on, by doubling; the last k - 1 words of the array have none."""
    n = max(0, hashes.shape[1] - k + 1)
    made, done, step, width = None, 0, hashes, 1
    while n:
        if k & width:
            part = step[:, done : done + n]
            made = part if made is None else joined(made, part)
            done += width
        if done == k:
            return made
        step = joined(step[:, :-width], step[:, width:])
        width *= 2
    return np.zeros((len(hashes), 0), np.uint64)


def sequence_hashes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """XXH3-128 of each text's whole sequence of word hashes, as two rows."""
    rows = np.ascontiguousarray(hashes.T)
    first = words.first.tolist()
    digests = b"".join(xxhash.xxh3_128_digest(rows[a:b]) for a, b in zip(first[:-1], first[1:], strict=True))
    return np.frombuffer(digests, "<u8").reshape(-1, 2).T


def whole_phrases(words: Words, k: int) -> np.ndarray:
    """Indices of the words from which k words follow in the same text."""
    n = len(words.start)
    left = np.repeat(words.first[1:], words.counts) - np.arange(n)
    return np.flatnonzero(left >= k)


def per_text(mask_or_values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over each text's words."""
    total = np.zeros(len(mask_or_values) + 1, np.int64)
    np.cumsum(mask_or_values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
