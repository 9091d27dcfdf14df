import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

import pytest

from caselake.llm import structure_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def searched(rows):
    """Cheapest, then ASCII-least edits by trying them all in that order; rows: (initial, fault)."""
    heap = [(0, "", "", 0)]  # cost, edits, roles so far, rows done
    while heap:
        cost, edits, out, i = heapq.heappop(heap)
        if i == len(rows) and GOOD.fullmatch(out):
            return cost, edits
        following = [(5, "I", "u", i), (5, "I", "a", i)]
        if i < len(rows):
            initial, fault = rows[i]
            following.append((2, "D", "", i + 1))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                following += [(more, "K", initial, i + 1), (1 + more, "R", "u", i + 1), (1 + more, "R", "a", i + 1)]
        for more, edit, role, j in following:
            if re.fullmatch(r"s?(ua)*u?", out + role):
                heapq.heappush(heap, (cost + more, edits + edit, out + role, j))


def symbol(row):
    return 4 * "sua?".index(row[0]) + ["", "blank", "duplicate", "truncated"].index(row[1])


def runs(rows):
    return [(s, len(list(g))) for s, g in groupby(map(symbol, rows))]


def test_repair_against_search():
    rng = random.Random(3)
    for _ in range(1500):
        faults = rng.choice([[""], ["", "", "truncated"], ["", "blank", "duplicate", "truncated"]])
        rows = [(rng.choice(rng.choice(["ua", "suaa?", "a"])), rng.choice(faults)) for _ in range(rng.randrange(0, 8))]
        assert R.repair(runs(rows)) == searched(rows), rows


def test_long_runs(monkeypatch):
    """Runs are unrolled in parts; a part's costs come from the powers."""
    rng = random.Random(4)
    cases = [[(rng.randrange(16), rng.choice([1, 2, 3, 40, 77])) for _ in range(5)] for _ in range(40)]
    want = [R.repair(c) for c in cases]
    monkeypatch.setattr(R, "UNROLLED", 7)
    assert [R.repair(c) for c in cases] == want
    for case in cases:  # runs cut in two are the same rows
        assert R.repair([(s, k) for s, n in case for k in (1, n - 1) if k]) == R.repair(case)
    assert R.repair([(4, 100_001)])[1].count("R") in (0, 50_000)


def ink(text):
    return re.sub(r"[\x20\x09-\x0D]+$", "", text)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def expected(convs, rows):
    out = []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv in convs:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), sha(r[3])))
        seen, marked = set(), []
        for _, _, role, text in own:
            fault = "blank" if not ink(text) else "duplicate" if (role, text) in seen else "truncated" if ink(text)[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = R.repair(runs(marked))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        lines, i, state = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else own[i][2:]
            i += e != "I"
            if e == "D":
                continue
            new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            role = role if e == "K" else new
            state = role[:1]
            lines.append(f"{role}:{text}")
        counts = [sum(f == x for _, f in marked) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


def got(spark, rows, damage=True):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", key int, kind string").repartition(3)
    df = R.damaged(df) if damage else df.selectExpr("conv_id", "turn", "role", "text", "1 AS copies")
    return sorted(map(tuple, R.repaired(df).collect()), key=str)


def test_given_table(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert got(spark, rows) == expected({r[0] for r in rows}, damaged(rows))


def test_edges(spark):
    rng = random.Random(6)
    rows = [(None, None, None, None), (None, 3, "user", "a."), (1, None, "system", "S."), (1, None, "user", "u?"), (1, 5, "", "x."), (2, 1, "user", "long. " * 60_000), (2, 2, "assistant", "é!"), (3, 0, "tool", " \x0b")]
    rows += [(7, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "usher"]), rng.choice(["Yes.", "no", "", "\t", "A.\n"])) for _ in range(120)]
    rows += [(8, 4, "user", "same row.")] * 30
    for damage in (True, False):
        assert got(spark, rows, damage) == expected({r[0] for r in rows}, damaged(rows) if damage else [(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in rows])
    assert got(spark, []) == []


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert got(spark, [(5, turn, "user", "x.")]) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("same", [False, True])
def test_one_long_conversation_is_dealt_over_tasks(spark, same):
    rows = [(1, k // 2, "user" if k % 3 else "assistant", "Same." if same else f"Text {k}.") for k in range(3000)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS copies")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    try:
        distinct, _ = R._prepared(df)
        assert sum(p.conv_id == 1 for p in R.pieces(R.marked(distinct)).collect()) > 1
        assert got(spark, rows, False) == expected({1, 2}, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "cut off"), (1, 3, "user", "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS copies")
    found = [tuple(r)[1:] for r in R.repaired_rows(df).orderBy("place").collect()]
    cost, audit = searched([("s", ""), ("a", ""), ("a", "truncated"), ("u", "blank")])
    (one,) = got(spark, rows, False)
    assert one[6:8] == (cost, audit) and "\n".join(f"{r}:{t}" for _, _, r, t in found).encode() and hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in found).encode()).hexdigest() == one[8]
    assert [e for _, e, _, _ in found] == [e for e in audit if e != "D"]
