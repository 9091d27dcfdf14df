import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from caselake.llm import substring_dedup as S
from caselake.llm.common import WORD
from tests.llm.test_common import thue_morse


def expected(rows, window=35):
    words = [re.findall(WORD, t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, window=35, gram=12):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, tag int, h string")
    got = S.factors(df, window=window, gram=gram)
    return sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(rows)
    assert sum(r[2] for r in want)
    assert run(spark, rows) == want


def test_random_passages(spark):
    rng = random.Random(4)
    for window, gram in ((35, 12), (5, 3), (6, 6)):
        vocabulary = [f"w{k}" for k in range(400 if window == 35 else 12)]
        text = lambda n: [rng.choice(vocabulary) for _ in range(n)]  # noqa: E731, B023
        passages = [text(rng.randrange(window - 2, 3 * window)) for _ in range(8)]
        rows = []
        for i in range(120):
            parts = []
            for _ in range(rng.randrange(1, 5)):
                p = list(rng.choice(passages))
                cut = rng.randrange(0, window)
                parts += rng.choice([p, p[cut:], p[: len(p) - cut], text(rng.randrange(0, 2 * window))])
            rows.append((i, " \n".join(parts)))
        assert run(spark, rows, window, gram) == expected(rows, window)


def test_edges(spark):
    period = "a b c " * 40
    rows = [(1, None), (2, ""), (3, "x " * 34), (4, "x " * 35), (5, "y " * 36), (6, period), (7, "one " + period), (8, " ".join(map(str, range(50)))), (8, " ".join(map(str, range(50)))), (8, "other text of the same id " + " ".join(map(str, range(9, 60))))]
    rows += [(None, " ".join(map(str, range(1000, 1040)))), (None, "z " + " ".join(map(str, range(1001, 1080)))), (9, " ".join(f"u{k}" for k in range(90_000))), (10, "é\x1f\xa0 " * 40)]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []


def test_parse_takes_the_longest_reference_and_crosses_boundaries():
    assert S.parse([(0, 2, 9, 0), (0, 5, 1, 70)], 5) == [(0, 9, 1, 70)]
    assert S.parse([(0, 2, 1, 3), (1, 5, 2, 10), (20, 21, 3, 0)], 5) == [(0, 6, 1, 3), (2, 7, 2, 12), (20, 5, 3, 20)]
    assert S.parse([], 5) == []


def test_matches_are_extended_along_one_reference_only():
    found = np.array([(0, 0, 3, 7, 1, 100), (0, 3, 2, 7, 1, 103), (0, 5, 2, 7, 1, 300), (0, 5, 1, 8, 1, 105), (1, 0, 4, 7, 1, 100), (1, 2, 9, 7, 1, 102)])
    runs = S.extended(dict(zip(("doc", "start", "n", "ref", "tag", "at"), found.T)))
    assert list(zip(*(x.tolist() for x in runs.values()))) == [(0, 0, 5, 7, 1, 100), (0, 5, 7, 7, 1, 295), (0, 5, 6, 8, 1, 100), (1, 0, 11, 7, 1, 100)]
    empty = np.zeros(0, np.int64)
    assert all(len(x) == 0 for x in S.extended(dict.fromkeys(("doc", "start", "n", "ref", "tag", "at"), empty)).values())


def plain_factors(rows, window):
    """Word by word: at each place the reference that goes on longest, of the first and the last copy of each window."""
    words = {i: re.findall(WORD, t or "") for i, t in rows}
    where = defaultdict(list)
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            where[tuple(w[k : k + window])].append((i, k))
    return words, where


def test_factors_against_a_plain_parser(spark):
    """Every factor is a copy of its reference, as long as that reference's words go on, and greedy from the left."""
    rng = random.Random(14)
    window, gram = 8, 3
    text = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    passages = [text(rng.randrange(10, 60)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, len(p) // 2)
            parts += rng.choice([p, p[cut:], p[: len(p) - cut], text(20)])
        rows.append((i, " ".join(parts)))
    words, where = plain_factors(rows, window)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(f.start, f.n_words, f.ref, f["at"]) for f in r.factors] for r in S.factors(df, window=window, gram=gram).collect()}
    longest = 0
    for i, w in words.items():
        ends, covered = -1, set()
        for start, n, ref, at in got[i]:
            assert n >= window and (ref, at) != (i, start)
            assert w[start : start + n] == words[ref][at : at + n]
            assert start >= ends - window + 1 and start + n > ends  # each opens beyond the last one's windows
            ends = start + n
            covered.update(range(start, start + n))
            longest = max(longest, n)
        repeated = {k + j for k in range(len(w) - window + 1) if len(where[tuple(w[k : k + window])]) > 1 for j in range(window)}
        assert covered == repeated
    assert longest > 3 * window  # blocks of at most 2 * window - gram words are extended

    # a copy of one reference alone is a single factor from end to end
    rows = [(1, " ".join(f"a{k}" for k in range(300))), (2, " ".join(f"a{k}" for k in range(40, 240)))]
    got = S.factors(spark.createDataFrame(rows, "doc_id long, text string"), window=window, gram=gram).where("doc_id = 2").first()
    assert [(f.start, f.n_words, f.ref, f["at"]) for f in got.factors] == [(0, 200, 1, 40)]


def test_words_like_thue_and_morse(spark):
    """Words and texts on which every polynomial hash modulo a power of two collides."""
    rows = []
    for size in (256, 512, 1024, 4096):
        x, y = thue_morse(size)
        rest = " ".join(f"r{size}x{k}" for k in range(34))
        rows += [(len(rows), f"{x} {rest}"), (len(rows) + 1, f"{y} {rest}")]
    for size in (512, 1024, 2048):
        x, y = (" ".join(t) for t in thue_morse(size))
        rows += [(len(rows), x), (len(rows) + 1, y)]
    assert run(spark, rows) == expected(rows)
    assert not any(r[2] for r in run(spark, rows[:8]))
