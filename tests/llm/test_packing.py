import functools
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caselake.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_against_library(library):
    rng = random.Random(3)
    pieces = ["the", "Étion", " ", " ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", "　", " ", "é", "日本", "'s", "12", "½", "...", "<|endoftext|>", "\x00", "\x1c", "a" * 300, "x\n", "\ny", "Ġ", "🙂"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 25))) for _ in range(3000)]
    got = P.PieceEncoder(PATH).encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, t), repr(t)


def test_long_texts_and_small_caches(library, monkeypatch):
    monkeypatch.setattr(P, "ENCODE_CHARS", 200)
    monkeypatch.setattr(P, "CACHE_BYTES", 5000)
    rng, words = random.Random(4), P.PieceEncoder(PATH)
    for n in (0, 10, 199, 200, 201, 3000):
        text = " ".join(rng.choice(["on", "the", "x,", "a.\nB", "wörter"]) + str(rng.randrange(99)) for _ in range(n))
        for t in (text, text + " ", " " + text):
            assert np.frombuffer(words.encode([t, "b c"])[0], "<u4").tolist() == ids_of(library, t)
        assert words.size < 5000 + 200 * 300


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        P.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level"):
        P.PieceEncoder(str(tmp_path / "t.json"))


def test_cut():
    assert P.cut(5, 10) == [(0, 5)] and P.cut(10, 10) == [(0, 10)]
    assert P.cut(23, 10) == [(0, 3), (3, 10), (13, 10)] and P.cut(20, 10) == [(0, 10), (10, 10)]


@functools.lru_cache(maxsize=None)
def least(lengths, capacity):
    """The least number of sequences: the longest document with each set of others that fits."""
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]
    best = len(lengths)
    for mask in range(1 << len(rest)):
        if first + sum(x for k, x in enumerate(rest) if mask >> k & 1) <= capacity:
            best = min(best, 1 + least(tuple(x for k, x in enumerate(rest) if not mask >> k & 1), capacity))
    return best


def counted(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


def test_reduction_keeps_an_optimal_packing():
    rng, fixed_some = random.Random(5), 0
    for _ in range(400):
        capacity = rng.choice([10, 20, 37])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, left = P.reduced(counted(lengths, capacity))
        rest = tuple(s for s in range(capacity, 0, -1) for _ in range(left[s]))
        assert all(sum(m) <= capacity and n > 0 for m, n in fixed)
        assert sorted(rest + tuple(x for m, n in fixed for x in m * n), reverse=True) == lengths
        assert sum(n for _, n in fixed) + least(rest, capacity) == least(tuple(lengths), capacity)
        fixed_some += len(rest) < len(lengths)
        made = P.plan(counted(lengths, capacity))
        assert made.bound <= least(tuple(lengths), capacity) <= made.sequences
    assert fixed_some > 300


def test_each_rule_is_used():
    def first(lengths, capacity):
        return P.dominating(counted(lengths, capacity), max(lengths))

    assert first([9, 8, 8], 10) == ((9,), 1) and first([9, 9, 8], 10) == ((9,), 2)
    assert first([7, 3, 2, 1, 1], 10) == ((7, 3), 1)  # filled
    assert first([6, 3, 2, 2], 9) == ((6, 3), 1) and first([6, 3, 3, 3], 10) == ((6, 3), 1)
    assert first([10, 9, 4, 4, 4], 20) == ((10, 9), 1)  # two are no longer than one
    assert first([10, 6, 3, 3, 3, 3], 20) is None  # 3 + 3 + 3 would do as well as 6 + 3
    assert first([10, 6, 4, 4, 3], 20) == ((10, 6, 4), 1)


def best_fit_one_by_one(lengths, capacity):
    rooms = []
    for s in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= s]
        room = min(fits, default=capacity)
        if fits:
            rooms.remove(room)
        rooms.append(room - s)
    return sorted(rooms)


def test_best_fit_of_groups_is_that_of_single_documents():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([12, 50, 100])
        lengths = [rng.randint(1, rng.choice([capacity, capacity // 3])) for _ in range(rng.randrange(0, 200))]
        groups = P.best_fit(counted(lengths, capacity))
        assert sorted(r for m, n in groups for r in [capacity - sum(m)] * n) == best_fit_one_by_one(lengths, capacity)


def test_places_are_gapless():
    rng = np.random.default_rng(7)
    for capacity, n in ((10, 1), (64, 500), (2048, 20_000)):
        lengths = np.minimum(rng.geometric(3 / capacity, n), capacity)
        made = P.plan(counted(lengths, capacity))
        order = rng.permutation(n)
        seen: dict = {}
        rank = np.array([seen.setdefault(int(s), []).append(0) or len(seen[int(s)]) - 1 for s in lengths])
        sequence, offset = made.places(lengths[order], rank[order])
        check_gapless(zip(sequence.tolist(), offset.tolist(), lengths[order].tolist(), strict=True), capacity)
        assert len(set(sequence.tolist())) == made.sequences >= made.bound


def check_gapless(rows, capacity):
    own: dict = {}
    for sequence, offset, length in rows:
        own.setdefault(sequence, []).append((offset, length))
    for held in own.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return len(own)


def expected(rows, library, capacity):
    out = []
    for i, t in rows:
        ids = np.array([*ids_of(library, t), 0], "<u4")
        out += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(P.cut(len(ids), capacity))]
    return sorted(out, key=str)


def test_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(5)
    rows = list(map(tuple, docs.collect()))
    got = list(map(tuple, P.pack(docs, PATH).collect()))
    want = expected(rows, library, 2048)
    assert sorted((r[:5] for r in got), key=str) == want
    used = check_gapless([(r[5], r[6], r[3]) for r in got], 2048)
    total = sum(r[3] for r in want)
    assert -(-total // 2048) <= used <= -(-total // 2048) + 1


def test_edges(spark, library):
    rows = [(None, "no id"), ("b", None), ("b", ""), ("c", "same row"), ("c", "same row"), ("d", "long " * 90_000), ("é", "end")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id string, text string, length int, rank string")
    packed = P.pack(df, PATH, 100, with_ids=True)
    got = packed.collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows, library, 100)
    check_gapless([(r.sequence_id, r.offset, r.length) for r in got], 100)
    by = {(r.sequence_id, r.offset): bytes(r.ids) for r in got}
    for s in P.sequences(packed).collect():
        assert bytes(s.ids) == b"".join(by[k] for k in sorted(by) if k[0] == s.sequence_id) and len(s.ids) == 4 * s.n_tokens
    assert P.pack(df.limit(0), PATH).collect() == []
