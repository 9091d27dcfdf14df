import hashlib
import random

import pytest
from pyspark.sql import functions as F

from caselake.llm import merkle as M


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climbed(digests):
    """Top of a tree, and for each leaf the digests before and behind it on every level."""
    sides, nodes, of = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(nodes) > 1:
        for k, i in enumerate(of):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            sides[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        of = [i // 8 for i in of]
    return (nodes or [""])[0], sides


def brute(rows, changed):
    """rows: (id, lang, text); changed: the texts met later."""
    first = lambda x: (x is not None, str(x).encode() if isinstance(x, str) else x)
    leaf = [sha("".join(map(value, r))) for r in rows]
    met = [sha("".join(map(value, (*r[:2], t)))) for r, t in zip(rows, changed, strict=True)]
    groups = {}
    for k in sorted(range(len(rows)), key=lambda k: (first(rows[k][0]) if rows[k][0] is not None else (False,), leaf[k])):
        groups.setdefault(rows[k][1], []).append(k)
    trees = {g: climbed([leaf[k] for k in ks]) for g, ks in groups.items()}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, over = climbed([trees[g][0] for g in order])
    out = []
    for g, more in zip(order, over, strict=True):
        for k, own in zip(groups[g], trees[g][1], strict=True):
            digest = met[k]
            for a, b in own + more:
                digest = sha(a + digest + b)
            out.append((rows[k][0], leaf[k], trees[g][0], root, sha("".join(a + b for a, b in own + more)), digest, digest == root))
    return out


def got(spark, rows, kind="long"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"doc_id {kind}, lang string, text string, g string, i int")
    changed = {"text": F.lower("text")}
    even = F.col("doc_id") % 2 == 0 if kind == "long" else None
    return M.manifest(df.repartition(3), ("doc_id", "lang", "text"), tampered=changed, where=even)


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("sizes", [[1], [8], [9], [64, 1], [1, 2, 65, 600], [1] * 70])
def test_trees_of_all_sizes(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(10**6), f"l{g}", f"Text {rng.random()}") for g, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(rows)
    want = brute(rows, [t.lower() if i % 2 == 0 else t for i, _, t in rows])
    assert sorted(map(key, got(spark, rows).collect())) == sorted(map(key, want))


def test_several_rounds(spark):
    """With blocks of eight nodes 700 leaves take four rounds, and 70 groups three."""
    rows = [(k, f"l{g}", f"T{k}") for g, n in enumerate([700, 8, 64, *[1] * 67]) for k in range(n)]
    want = brute(rows, [t for *_, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = M.manifest(df.repartition(4), ("doc_id", "lang", "text"), levels=1).collect()
    assert sorted(map(key, found)) == sorted(map(key, want))


def test_blocks_on_the_way_back(spark):
    """9,000 leaves are three blocks; every path leads to the top."""
    digests = [sha(str(k)) for k in range(9000)]
    top, sides = climbed(digests)
    rows = spark.createDataFrame([(k, "a", 0, d, d) for k, d in enumerate(digests)], "i long, g string, id int, leaf string, found string").repartition(4)
    trees = M.rising(rows.select("g", "i", F.col("leaf").alias("digest")))
    assert trees[-1].first().digest == top and len(trees) == 3
    start = trees[-1].select("g", "i", F.lit("").alias("path"), F.lit("S").alias("subroot"))
    found = M.proven(rows, M.descended(trees, start), top, True).select("leaf", "proof", "verified", "subroot").collect()
    assert all(r.verified and r.subroot == "S" for r in found)
    want = {d: "".join(f"{a}.{b}/" for a, b in s) for d, s in zip(digests, sides, strict=True)}
    assert {r.leaf: r.proof for r in found} == want


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 513, 4095, 4096])
def test_sweep(n):
    digests = [sha(str(k)) for k in range(n)]
    top, sides = climbed(digests)
    sweep = M.Sweep(digests, M.height(n, False, 4))
    assert sweep.top == top
    paths = sweep.proofs("x.y/")
    assert paths == ["".join(f"{a}.{b}/" for a, b in s) + "x.y/" for s in sides]
    assert all(M.fold(d, p.removesuffix("x.y/")) == top for d, p in zip(digests, paths, strict=True))


def test_edges(spark):
    rows = [(None, None, "no id"), (None, None, None), (1, None, ""), (2, "", "Same"), (2, "", "Same"), (2, "", "Other"), (3, "é", "A" * 300_000), (4, "z", None), (-5, "z", "B")] + [(7, "same", "Row")] * 40
    want = brute(rows, [t.lower() if t and i is not None and i % 2 == 0 else t for i, _, t in rows])
    assert sorted(map(key, got(spark, rows).collect())) == sorted(map(key, want))
    texts = [("b", "x", "T"), ("a", "x", "u"), (None, "x", "V")]
    assert sorted(map(key, got(spark, texts, "string").collect())) == sorted(map(key, brute(texts, [t.lower() for _, _, t in texts])))
    assert got(spark, []).collect() == []


def test_unchanged_rows_verify(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = M.manifest(docs, ("doc_id", "text")).groupBy("verified").count().collect()
    assert [tuple(r) for r in found] == [(True, docs.count())]
