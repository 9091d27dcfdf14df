import random
import re
from collections import Counter

import numpy as np

from caselake.llm import near_dedup as N
from caselake.llm.common import WORD
from tests.llm.test_common import thue_morse, words_of


def sets(text):
    w = re.findall(WORD, text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows, threshold=0.8):
    """Classes of ids by comparing every pair that shares a shingle."""
    words = [tuple(re.findall(WORD, t or "")) for _, t in rows]
    every = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    where = {}
    for k, s in enumerate(every):
        for x in s:
            where.setdefault(x, []).append(k)
    tried = set()
    for ks in [*where.values(), [k for k, w in enumerate(words) if not w]]:
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    same = len(every[a] & every[b])
                    if words[a] == words[b] or same >= threshold * (len(every[a]) + len(every[b]) - same) > 0:
                        parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root(k), []).append(i)
    low = {r: (None if None in v else min(v)) for r, v in least.items()}
    return sorted(((i, low[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, tag int, node string")


def run(spark, rows):
    return sorted(map(tuple, N.near_duplicates(frame(spark, rows)).collect()), key=str)


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(rows)
    assert len({c for _, c in want}) < len(rows)
    assert run(spark, rows) == want


def copies(rng, n, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    out = []
    for _ in range(n):
        c = list(base)
        for _ in range(rng.randrange(0, edits + 1)):
            c[rng.randrange(len(c))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(c))
    return out


def test_groups_and_edges(spark):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(t for g in range(8) for t in copies(rng, rng.choice([1, 2, 40]), 9))]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "one\ttwo"), (1005, "one two three"), (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(2000, " ".join(f"v{k}" for k in range(60_000))), (2001, " ".join(f"v{k}" for k in range(3, 60_000)))]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []


def test_one_of_each(spark):
    rng = random.Random(9)
    texts = copies(rng, 5, 3) + ["alone " * 9 + "x", "alone " * 9 + "x"]
    df = frame(spark, [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])])
    got = N.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 5]


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    a = {int(k): float(w) for k, w in zip(rng.integers(1, 1 << 62, 300), rng.exponential(2, 300) + 0.1)}
    b = {k: w * rng.choice([0.5, 1, 3]) for k, w in list(a.items())[:230]} | {int(k): 1.0 for k in rng.integers(1, 1 << 62, 80)}
    true = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    element = np.array([*a, *b], np.uint64)
    got = N.signatures(element, np.array([*a.values(), *b.values()]), np.array([0, len(a), len(a) + len(b)]), 8192)
    assert abs((got[0] == got[1]).mean() - true) < 0.02


def test_shared_passages_and_chains(spark):
    """Documents that share a long passage collide in bands; only those with similar rests are near-duplicates."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(120)]
    rows = []
    for i in range(150):
        own = [f"q{rng.randrange(10**6)}" for _ in range(rng.choice([20, 40, 200]))]
        rows.append((i, " ".join(passage + own)))
        if i % 10 == 0:  # a chain: each a little further from the first
            text = passage + own
            for k in range(4):
                text = list(text)
                for _ in range(2):
                    text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
                rows.append((1000 + 10 * i + k, " ".join(text)))
    assert run(spark, rows) == expected(rows)


def repeated_line_pairs(n):
    """n pairs of Jaccard similarity 0.82: a text, and its copy with a line of 22 words appended 50 times."""
    rows = []
    for k in range(n):
        text, line = (" ".join(f"{c}{k}x{i}" for i in range(m)) for c, m in (("b", 120), ("l", 22)))
        rows += [(2 * k, text), (2 * k + 1, text + ("\n" + line) * 50)]
    return rows


def test_copies_with_an_often_repeated_line(spark):
    rows = repeated_line_pairs(24)
    assert run(spark, rows) == expected(rows) == sorted(((i, i - i % 2) for i, _ in rows), key=str)


def test_bands_by_weight_one():
    """Texts of the same distinct shingles share every band of weight 1; a text without repeats has no other bands."""
    element = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys, first = N.all_bands(np.concatenate([element, element]), np.array([1] * 40 + [1, 90] * 20), np.array([0, 40, 80, 80]))
    once, often = set(keys[: first[1]].tolist()), set(keys[first[1] : first[2]].tolist())
    assert len(once) == N.BANDS and once < often and first[3] == first[2]


def test_shingles_against_brute_force():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in [*range(0, 9), 40, 400]]
    words = words_of(texts)
    element, count, first = N.shingles(words, N.word_hashes(words))
    named = {}
    for k, t in enumerate(texts):
        w = t.split()
        want = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        own = slice(first[k], first[k + 1])
        assert sorted(count[own].tolist()) == sorted(want.values()) and (np.diff(element[own].astype(object)) > 0).all()
        named[k] = set(element[own].tolist())
    for a in range(len(texts)):
        for b in range(a):
            assert len(named[a] & named[b]) == len(sets(texts[a]) & sets(texts[b]))


def test_words_and_texts_like_thue_and_morse(spark):
    """Different texts on which every polynomial hash modulo a power of two collides stay different."""
    rows = [(k, t) for k, t in enumerate(x for n in (256, 1024, 4096) for x in thue_morse(n))]
    rows += [(100 + k, " ".join(t)) for k, t in enumerate(x for n in (512, 1024, 2048) for x in thue_morse(n))]
    assert run(spark, rows) == expected(rows)
    got = N.one_of_each(frame(spark, rows[:6]))
    assert got.count() == 6


def test_crowded_keys_meet_in_blocks(spark, monkeypatch):
    """Members of one key and followers of one leader in chunks of two: no pair is lost, and none is compared twice."""
    monkeypatch.setattr(N, "CHUNK", 2)
    rng = random.Random(12)
    rows = [(i, t) for i, t in enumerate(copies(rng, 25, 12))]
    assert run(spark, rows) == expected(rows)
    group = spark.createDataFrame([(1, k, 40, k, 1) for k in range(9)] + [(2, 50, 40, 50, 1)], "key long, node long, n long, component long, place long")
    got = [(r.u, r.v) for r in N._apart(group, 0.8).collect()]
    assert sorted(got) == [(a, b) for a in range(9) for b in range(a + 1, 9)]
