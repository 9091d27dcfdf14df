import random
from fractions import Fraction

import pytest

from caselake.llm import mixing as M


def test_period_deviates_by_less_than_a_block():
    rng = random.Random(1)
    for _ in range(40):
        w = {f"s{k}": rng.randrange(1, 60) for k in range(rng.randrange(1, 12))}
        total, slots = sum(w.values()), M.period(w)
        assert sorted(x for v in slots.values() for x in v) == list(range(total))
        for name, at in slots.items():
            for t in range(total + 1):
                assert abs(sum(x < t for x in at) - Fraction(t * w[name], total)) < 1


def simulated(blocks, weights):
    """Slot by slot, with the phases' rule, over the blocks themselves."""
    out, used, t, start, base = {}, dict.fromkeys(blocks, 0), 0, 0, dict.fromkeys(blocks, 0)
    while any(used[s] < blocks[s] for s in blocks):
        active = {s: weights[s] for s in blocks if used[s] < blocks[s]}
        total = sum(active.values())
        while all(used[s] < blocks[s] for s in active):
            ready = []
            for s, w in active.items():
                k = used[s] - base[s]
                if k * total // w <= t - start:
                    ready.append((-(-(k + 1) * total // w), s))
            _, s = min(ready)
            out[s, used[s]] = t
            used[s] += 1
            t += 1
        start, base = t, dict(used)
    return out


def test_phases_against_simulation():
    rng = random.Random(2)
    for _ in range(30):
        names = [f"s{k}" for k in range(rng.randrange(1, 6))]
        weights = {s: rng.randrange(1, 9) for s in names}
        blocks = {s: rng.randrange(0, 60) for s in names}
        got = {}
        for s, first, many, since, total, places in M.phases(blocks, weights):
            for k in range(many):
                got[s, first + k] = since + k // len(places) * total + places[k % len(places)]
        assert got == simulated(blocks, weights)


def test_weights():
    assert sum(M.whole_weights({"a": 1, "b": 1, "c": 1e-9}, 100).values()) == 100
    with pytest.raises(ValueError):
        M.whole_weights({"a": 0}, 10)


TARGETS = M.Targets({"src0": 5, "src1": 3, "src2": 1}, other=2, block_size=3000, resolution=40, bucket_rows=7)


def expected(rows):
    """slots of (doc_id, source, hash, size, key) rows, source by source."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1] if r[1] in TARGETS.weights else "*", []).append(r)
    blocks, placed = {}, {}
    for g, own in groups.items():
        at = 0
        for r in sorted(own, key=lambda r: (r[4] % (1 << 64), r[0])):
            placed.setdefault(g, []).append((r, at))
            at += r[3]
        blocks[g] = max(1, -(-at // TARGETS.block_size))
    named = M.whole_weights({**TARGETS.weights, "*": TARGETS.other}, TARGETS.resolution)
    names = {g: "*" if g == "*" else f"={g}" for g in blocks}
    slots = simulated({names[g]: n for g, n in blocks.items()}, {names[g]: named[g] for g in blocks})
    out = []
    for g, own in placed.items():
        for r, at in own:
            b = min(at // TARGETS.block_size, blocks[g] - 1)
            out.append((r[0], r[1], slots[names[g], b], b, at - b * TARGETS.block_size))
    return sorted(out, key=str)


def check(spark, df):
    from pyspark.sql import functions as F

    keyed = M._slim(df, "doc_id", "text", "source").withColumn("key", F.xxhash64("doc_id", "hash", F.lit(TARGETS.seed)))
    rows = [tuple(r) for r in keyed.collect()]
    got = sorted(map(tuple, M.mixed(df, TARGETS).select("doc_id", "source", "slot", "block", "offset").collect()), key=str)
    assert got == expected(rows)
    return got


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = check(spark, df)
    assert len(got) == df.count()


def test_edges_and_order(spark):
    rows = [(1, None, "src0", 0), (2, "", None, 0), (None, "x" * 9000, "src1", 1), (4, "é" * 100, "new", 2), (4, "é" * 100, "new", 2)] + [(k, "y" * (k * 37 % 4000), f"src{k % 4}", k) for k in range(10, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    check(spark, df.dropDuplicates())
    places = sorted((r.slot, r.offset) for r in M.mixed(df, TARGETS).where("doc_id = 4").collect())
    (slot, first), (other, second) = places  # copies follow each other
    assert (other - slot, second - first) == (0, 100) or other > slot
    ordered = M.in_order(df, TARGETS)
    assert ordered.columns == df.columns and ordered.count() == len(rows)
    assert M.mixed(df.limit(0), TARGETS).count() == 0
    place = {(r.doc_id, r.source): (r.slot, r.offset) for r in M.mixed(df.dropDuplicates(), TARGETS).collect()}
    got = [place[r.doc_id, r.source] for r in M.in_order(df.dropDuplicates(), TARGETS).collect()]
    assert got == sorted(got)


def test_copies_in_parts(spark, monkeypatch):
    """One row repeated many times keeps all its places, in parts."""
    monkeypatch.setattr(M, "COPIES", 7)
    df = spark.createDataFrame([(None, None, None)] * 20 + [(1, "z" * 900, "src0")] * 30 + [(2, "y" * 50, "src0")] * 7, "doc_id long, text string, source string")
    got = [tuple(r) for r in M.mixed(df, TARGETS).select("doc_id", "slot", "block", "offset").collect()]
    assert len(got) == 57
    at = sorted(b * TARGETS.block_size + o for i, _, b, o in got if i == 1)
    assert at == list(range(at[0], at[0] + 30 * 900, 900))
    placed = M.with_places(df, TARGETS, "place")
    assert placed.columns == ["doc_id", "text", "source", "place"] and placed.count() == 57
