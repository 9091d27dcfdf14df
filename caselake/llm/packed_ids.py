"""Token ids in binary files with a fixed number of bits for each id, the least that the vocabulary allows.

A file holds whole documents in ascending id order: a header, the document ids, each document's first token, the byte
offset of every block of BLOCK ids, and the blocks. A block unpacks with a few numpy operations, and a document needs only
the blocks that it touches. Documents are dealt out by range of (id, text hash), so file names in order give the corpus in
order, and no task holds more than its range.

Words are encoded by the tokenizers library. As its normaliser and pre-tokeniser never join what ASCII white space
separates, the ids of a text are those of its words in turn; each worker keeps about CACHE_BYTES of them. A run of ASCII
letters is looked up in lower case and without the full stops and commas behind it, which are pre-tokens of their own. This
holds for the specification below (NORMALIZER, PRE_TOKENIZER, added tokens as they are); any other tokenizer is refused.

Defined results: a null text is an empty text and holds the end id alone; rows of one id stand in the order of their
text hashes, repeated rows one after the other; a null id comes first; a very long text stays in one file, whose blocks
are read by themselves; an empty table gives no files; other columns don't matter, whatever their names. Ids are integers;
under ANSI rules an id of another type that is no integer is an error.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, put_file, slices, text_bytes

MAGIC = b"FIXBITS1"
BLOCK = 4096
FILE_BYTES = 16 << 20
#: About the most bytes of words and ids that a worker keeps, the objects of a word or of a core counted as so many.
CACHE_BYTES = 256 << 20
WORD_BYTES, CORE_BYTES = 115, 150
SEPARATOR = "\x01"

# fixed values: what the word split was proven for
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def check_specification(spec: dict) -> None:
    """Refuse a tokenizer whose texts' ids may be others than those of their words in turn."""
    model = spec["model"]
    known = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and not spec.get("post_processor")
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token") and not model.get("byte_fallback") and not model.get("ignore_merges")
    # an added token is found in the raw text: it must lie within a word, and in no run of letters with full stops or commas behind
    apart = all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) and re.fullmatch(r"<\|\w+\|>", t["content"], re.A) for t in spec["added_tokens"])
    if not (known and plain and apart):
        raise ValueError("only tokenizers of the specification in packed_ids are encoded word by word")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, each in `bits` bits, the highest first; zero bits fill the last byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    n = -(-len(ids) // 8) * 8
    v = np.zeros(n, np.uint64)
    v[: len(ids)] = ids
    v = v.reshape(-1, 8)
    out = np.zeros((len(v), bits), np.uint8)
    for k in range(8):  # eight ids fill `bits` bytes
        first, last = k * bits // 8, ((k + 1) * bits - 1) // 8
        for b in range(first, last + 1):
            shift = (k + 1) * bits - 8 * (b + 1)
            out[:, b] |= ((v[:, k] >> np.uint64(shift) if shift >= 0 else v[:, k] << np.uint64(-shift)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    rows = -(-n // 8)
    raw = np.frombuffer(data.ljust(rows * bits, b"\0"), np.uint8, rows * bits).reshape(rows, bits).astype(np.uint64)
    out = np.zeros((rows, 8), np.uint64)
    for k in range(8):
        first, last = k * bits // 8, ((k + 1) * bits - 1) // 8
        for b in range(first, last + 1):
            shift = (k + 1) * bits - 8 * (b + 1)
            out[:, k] |= raw[:, b] << np.uint64(shift) if shift >= 0 else raw[:, b] >> np.uint64(-shift)
        out[:, k] &= np.uint64((1 << bits) - 1)
    return out.ravel()[:n].astype(np.uint32)


HEADER = struct.Struct("<8sIIQQ")


def file_bytes(doc_ids: list, counts: list[int], ids: np.ndarray, bits: int) -> bytes:
    known = np.array([d is not None for d in doc_ids])
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    first = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = HEADER.pack(MAGIC, bits, BLOCK, len(doc_ids), len(ids))
    return b"".join([head, np.packbits(known).tobytes(), numbers.tobytes(), first.tobytes(), offsets.tobytes(), *blocks])


class PackedFile:
    """Reads a file's bytes; `ids(a, b)` unpacks only the blocks that tokens a to b lie in."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, n, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        at = HEADER.size
        self.known = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at))[:n].astype(bool)
        at += -(-n // 8)
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        at += 8 * n
        self.first = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        self.offsets = np.frombuffer(data, "<u8", -(-self.n_ids // self.block) + 1, at).astype(np.int64)
        self.data, self.base = data, at + 8 * len(self.offsets)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = a // self.block, -(-b // self.block)
        parts = [unpack(self.data[self.base + self.offsets[k] : self.base + self.offsets[k + 1]], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(i, j)]
        return np.concatenate(parts)[a - i * self.block : b - i * self.block]

    def document(self, row: int) -> np.ndarray:
        return self.ids(int(self.first[row]), int(self.first[row + 1]))


class WordEncoder:
    """The library's ids for texts, word by word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            check_specification(json.load(f))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = max(self.library.get_vocab().values()) + 1
        self.word_bytes = self.core_bytes = 0
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        mark = self.library.encode(SEPARATOR, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _learn(self, cores: list[str]) -> None:
        joined = [c for c in cores if self.mark is not None and SEPARATOR not in c]
        groups = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        between = f" {SEPARATOR} "
        for group, made in zip(groups, self.library.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(group) - 1:
                raise ValueError("words can't be told apart")
            flat = ids.tobytes()
            ends = (4 * cuts).tolist()
            self.cores.update(zip(group, (flat[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(flat)], strict=True)), strict=True))
        alone = [c for c in cores if self.mark is None or SEPARATOR in c]
        for c, made in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.cores[c] = np.array(made.ids, "<u4").tobytes()

    @staticmethod
    def _parts(word: bytes) -> tuple[str, str]:
        bare = word.rstrip(b".,")
        if bare.isalpha():  # ASCII letters alone
            return bare.lower().decode(), word[len(bare) :].decode()
        text = word.decode()
        core = text.rstrip(".,")
        if core.isascii():
            return text, ""
        # letters whose normal or lower form has other characters than letters stay with what follows them
        plain = core.isalpha() and core.lower().isalpha() and unicodedata.is_normalized("NFC", core)
        return (core, text[len(core) :]) if plain else (text, "")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.word_bytes + self.core_bytes > CACHE_BYTES:
            self.words.clear()  # made again from their cores, which cost the library's time
            self.word_bytes = 0
            if self.core_bytes > CACHE_BYTES * 3 // 4:
                self.cores.clear()
                self.core_bytes = 0
        split = [t.split() for t in texts]
        known = self.words.get
        made = [list(map(known, s)) for s in split]
        new = {w for s, m in zip(split, made, strict=True) for w, ids in zip(s, m, strict=True) if ids is None}
        if new:
            self._learn_words(new)
            get = self.words.__getitem__
            made = [[ids if ids is not None else get(w) for w, ids in zip(s, m, strict=True)] for s, m in zip(split, made, strict=True)]
        return [b"".join(m) for m in made]

    def _learn_words(self, words: set[bytes]) -> None:
        new = {w: self._parts(w) for w in words}
        cores = list(set(chain.from_iterable(new.values())).difference(self.cores))
        self._learn(cores)
        core = self.cores
        made = {w: core[a] + core[b] if b else core[a] for w, (a, b) in new.items()}
        self.words.update(made)
        self.word_bytes += WORD_BYTES * len(made) + sum(map(len, made)) + sum(map(len, made.values()))
        self.core_bytes += CORE_BYTES * len(cores) + sum(len(c) + len(core[c]) for c in cores)


_LOADED: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def write(docs: DataFrame, folder: str, path: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text", max_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of every whole text to files in `folder`; a row (name, n_docs, n_ids) for each. Runs when it is read."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def files(it):
        part, k = TaskContext.get().partitionId(), 0
        words = encoder(path)
        bits = max(1, (words.vocabulary - 1).bit_length())
        if end_id is not None and end_id >> bits:
            raise ValueError("the end id doesn't fit the vocabulary")
        end = b"" if end_id is None else struct.pack("<I", end_id)
        held_ids, held, size, done = [], [], 0, []

        def flush():
            nonlocal k, held_ids, held, size
            if held_ids:
                data = file_bytes(held_ids, [len(h) // 4 for h in held], np.frombuffer(b"".join(held), "<u4"), bits)
                put_file(folder, name := f"part-{part:010d}-{k:06d}.ids", data)
                done.append((name, len(held_ids), size // 4))
                k, held_ids, held, size = k + 1, [], [], 0

        for batch in it:
            data, offsets = text_bytes(batch.column(1))
            numbers = batch.column(0).to_pylist()
            for i, j in slices(offsets):
                whole = data[offsets[i] : offsets[j]].tobytes()
                cut = (offsets[i : j + 1] - offsets[i]).tolist()
                for number, ids in zip(numbers[i:j], words.encode([whole[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]), strict=True):
                    held_ids.append(number)
                    held.append(ids + end)
                    size += len(ids) + len(end)
                    if size * bits >= max_bytes * 32:
                        flush()
        flush()
        import pyarrow as pa

        yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["name", "n_docs", "n_ids"]).astype({"name": "string", "n_docs": "int64", "n_ids": "int64"}), preserve_index=False)

    return mapped(dealt, files, "name string, n_docs long, n_ids long")


def with_starts(files: DataFrame) -> DataFrame:
    """files and base, the ids in all files before each. One narrow row for each file of FILE_BYTES is all that is ordered."""
    w = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))


def read(spark, folder: str) -> DataFrame:
    """(name, doc_id, first, n_tokens, ids_crc32) of each document in the folder's files; first counts within its file."""

    def rows(it):
        for pdf in it:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                f = PackedFile(data)
                ids = f.ids(0, f.n_ids).astype("<u4").tobytes()
                counts = np.diff(f.first)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(f.first[:-1].tolist(), f.first[1:].tolist(), strict=True)]
                numbers = pd.array(f.doc_ids.copy(), dtype="Int64")
                numbers[~f.known] = pd.NA
                yield pd.DataFrame({"name": path.rsplit("/", 1)[-1], "doc_id": numbers, "first": f.first[:-1], "n_tokens": counts, "ids_crc32": crc})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    return files.mapInPandas(rows, "name string, doc_id long, first long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str, path: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text", max_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files, read them, and return doc_id, start, n_tokens and ids_crc32 as they hold them."""
    from .common import written

    files = written(write(docs, folder, path, end_id, doc_id, text, max_bytes), "packed-manifest")
    if files.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    bases = with_starts(files).select("name", "base")
    return read(docs.sparkSession, folder).join(bases, "name").select("doc_id", (F.col("first") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
