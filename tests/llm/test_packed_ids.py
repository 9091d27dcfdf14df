import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caselake.llm import packed_ids as P
from caselake.llm.common import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_packing_every_width():
    rng = np.random.default_rng(2)
    for bits in range(1, 33):
        for n in (0, 1, 7, 8, 9, 4096, 5001):
            ids = rng.integers(0, 1 << bits, n, np.uint64).astype(np.uint32)
            data = P.pack(ids, bits)
            assert len(data) == -(-n * bits // 8)
            assert (P.unpack(data, n, bits) == ids).all()


def test_random_access():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9000, 40).tolist()
    ids = rng.integers(0, 49408, sum(counts)).astype(np.uint32)
    f = P.PackedFile(P.file_bytes([None, *range(39)], counts, ids, 17))
    for row in (0, 3, 17, 39):
        assert (f.document(row) == ids[sum(counts[:row]) : sum(counts[: row + 1])]).all()
    assert f.known.tolist() == [False] + [True] * 39


def test_words_against_library(library):
    rng = random.Random(5)
    pieces = ["The", "thonand,", " ", "  ", "\n", "\t", "\x0b", "\x1c", "é", "é", "́", "ñ.", "İ", "Σ", "ΑΣ.", "ǅ", "日本語", "'s", "'ll.", "12345", "½", "　", "\xa0", "<|endoftext|>", "<|startoftext|>", "***", "...,", "a" * 70, "\x00", "\x01", "K", "Å", "ﬁ", "ẞ", "x.y", "a,b"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    got = P.encoder(PATH).encode([t.encode() for t in texts])
    for t, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(t)


def expected(rows, library):
    out, start = [], 0
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    got = P.round_trip(docs, shared_folder(spark, "t"), PATH, 1, max_bytes=20_000).collect()
    assert sorted(map(tuple, got)) == expected(rows, library)


def test_edges(spark, library):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "same row"), (3, "same row"), (9, "long " * 90_000), (10, "end")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, name string")
    got = P.round_trip(df, shared_folder(spark, "t"), PATH, 1)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(rows, library)
    assert P.round_trip(df.limit(0), shared_folder(spark, "t"), PATH, 1).collect() == []


def test_other_tokenizers_are_refused(tmp_path):
    """The word split holds for one specification; whatever departs from it raises."""
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    P.check_specification(spec)
    with pytest.raises(ValueError, match="word by word"):
        P.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for change in (
        {"normalizer": None},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"post_processor": {"type": "ByteLevel"}},
        {"model": spec["model"] | {"dropout": 0.1}},
        {"added_tokens": [*spec["added_tokens"], spec["added_tokens"][0] | {"content": "of the"}]},
        {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]},
    ):
        with pytest.raises(ValueError, match="word by word"):
            P.check_specification(spec | change)


def test_cache_is_bounded_by_bytes(library, monkeypatch):
    monkeypatch.setattr(P, "CACHE_BYTES", 20_000)
    words = P.WordEncoder(PATH)
    for k in range(40):
        text = " ".join(f"w{k}x{j}" for j in range(60))
        assert np.frombuffer(words.encode([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert words.word_bytes + words.core_bytes < 60_000 and len(words.words) < 200
