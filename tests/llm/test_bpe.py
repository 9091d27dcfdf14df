import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caselake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(texts, library):
    got = bpe.load(PATH).encode(texts)
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text[:80]
        assert bpe.load(PATH).decode(np.frombuffer(ids, "<u4")) == library.decode(want.ids, skip_special_tokens=False) == text


def test_fuzz(library):
    rng = random.Random(5)
    pieces = ["the", "Thonand,", " ", "  ", "\n", "\t", "\r\n", "é", "ñ", "日本語", "𝒳", "'s", "'ll", "don't", "12345", "½", "　", "\x85", "\xa0", "\x1c", "\x1f", "​", "<|endoftext|>", "<|endoftext", "***", "&&&", "a" * 70, "ab" * 40, "!?", "\x00", "ﬁ", "Ⅷ", "٣", "﻿", "xyzzyqwfp"]
    same(["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40))) for _ in range(1500)], library)
    same([" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40))) for _ in range(500)], library)
    same(["", " ", "\n", "x" * 5000, "ab" * 20000, "<|endoftext|>", "a<|endoftext|><|endoftext|> b "], library)


def test_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.encode(docs, PATH).collect()
    assert len(got) == len(texts)
    for r, want in zip(got, library.encode_batch([texts[r.doc_id] for r in got], add_special_tokens=False)):
        assert r.ids == want.ids


def test_edges(spark):
    rows = [(1, None, 0), (1, None, 0), (2, "", 1), (None, "two words", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    made = bpe.encode(df, PATH, keep=("doc_id",))
    assert [len(r.ids) for r in made.collect()] == [0, 0, 0, 2]
    assert [r.text for r in bpe.decode(made, PATH).collect()] == ["", "", "", "two words"]
    assert [r.text for r in bpe.decode(bpe.encode(df, PATH, arrays=False), PATH).collect()] == ["", "", "", "two words"]
    assert bpe.encode(df.limit(0), PATH).count() == 0
    both = bpe.round_trip(df, PATH).collect()
    for r in both:
        text = dict((k, t) for k, t, _ in rows)[r.doc_id] or ""
        assert r.n_tokens == len(r.ids) // 4 and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()


def test_clashing_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, None, None)], "doc_id long, text string, ids int, __in string")
    rows = sorted(map(tuple, bpe.encode(df, PATH, arrays=False).collect()), key=str)
    assert len(rows) == 3 and rows[0] == rows[1] and rows[2] == (None, b"")
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
    for keep in (("doc_id", "ids"), ("IDS",)):
        with pytest.raises(ValueError, match="kept columns"):
            bpe.encode(df, PATH, keep=keep)


def test_caches_are_bounded_by_bytes(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 30_000)
    own = bpe.Bpe(PATH)
    for k in range(30):
        text = " ".join([*(f"w{k}x{j}" for j in range(60)), "ab" * 5000 + str(k), "z" * 9000 + "," + "é" * 3000])
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        held = [*own.words.items(), *own.pieces.items()]
        assert own.size == sum(bpe.ENTRY_BYTES + len(a) + len(b) for a, b in held) < 90_000
        assert all(len(a) <= bpe.KEPT_CHARS for a, _ in held)
