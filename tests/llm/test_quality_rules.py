import re
from collections import Counter, defaultdict

from caselake.llm import quality_rules as Q
from caselake.llm.common import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def base(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def verdicts(rows, limits):
    norm = lambda s: " ".join(s.lower().split())
    texts, lines = defaultdict(set), defaultdict(set)
    for _, t, _, h, _ in rows:
        texts[h].add(t or "")
        for x in (t or "").split("\n"):
            if re.search(WORD, x):
                lines[h, norm(x)].add(t or "")
    out = []
    for i, t, _, h, _ in rows:
        n, *_, failed = base(t)
        bad = lambda x: limits.least < len(lines[h, norm(x)]) and len(lines[h, norm(x)]) > limits.share * len(texts[h])  # noqa: E731, B023
        left = sum(len(re.findall(WORD, x)) for x in (t or "").split("\n") if re.search(WORD, x) and not bad(x))
        out.append((i, *base(t), not failed and left >= limits.left * n))
    return sorted(out, key=str)


def run(spark, rows, limits):
    df = spark.createDataFrame(rows, SCHEMA)
    got = Q.judged(Q.profiles(df, "text", ["doc_id", "source"]), "doc_id", "source", limits)
    return sorted(map(tuple, got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()), key=str)


def test_table_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    limits = Q.LineLimits(least=2, share=0.05)
    assert run(spark, rows, limits) == verdicts(rows, limits)


def test_edges(spark):
    body = lambda k: "\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(12)) for i in range(6))
    foot = "Read our  terms" + " of use" * 60
    rows = [(k, body(k) + "\n" + foot.upper() * (k % 2) + foot * (1 - k % 2), "en", "h", 1) for k in range(8)]
    rows += [(8, foot, "en", "h", 1), (8, foot, "en", "h", 1), (None, None, None, None, None), (9, "", "en", None, 0), (10, "é ü\x1fa # <b>\r\n\x0b", "xx", "h", 9)]
    rows += [(11, " ".join(f"q{i % 4000}" for i in range(60000)), "en", "h", 1), (11, body(99), None, "other", None)]
    limits = Q.LineLimits(least=3, share=0.1)
    assert run(spark, rows, limits) == verdicts(rows, limits)
    assert run(spark, [], limits) == []


def test_clean_takes_effect_and_keeps_columns(spark):
    body = lambda k: "\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(12)) for i in range(6))
    rows = [(k, body(k) + "\nshared line here", "en", "h", 1, k, "x") for k in range(8)] + [(50, "too short", "en", "h", 1, 0, "x"), (3, body(3) + "\nshared line here", "en", "h", 1, 3, "x")]
    df = spark.createDataFrame(rows, SCHEMA + ", h long, __hash string")
    got = Q.clean(df, limits=Q.LineLimits(least=3, share=0.1))
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.h) for r in got.collect()) == sorted([(k, body(k), k) for k in range(8)] + [(3, body(3), 3)])


def test_limits_act_on_the_tables(spark):
    """The production limits take lines from the given tables, and reject a document for it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = verdicts(rows, Q.LineLimits())
    assert run(spark, rows, Q.LineLimits()) == want
    assert any(not r[-1] and not r[-2] for r in want)
