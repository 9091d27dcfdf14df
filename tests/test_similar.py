import random

import pyarrow as pa
import pytest

from caselake.config import Similarity
from caselake.operators import similar

RULES = Similarity(lexicon=("ab", "bc", "cd", "de", "ef", "fa"))


def brute(rows, limit):
    out = {}
    for a in rows:
        found = []
        for b in rows:
            terms = [t for t in RULES.lexicon if t in a[6] and t in b[6]]
            same = [k for k in (3, 4, 5) if a[k] and a[k] == b[k]]
            score = sum({3: 60, 4: 15, 5: 5}[k] for k in same) + min(30, 6 * len(terms))
            if score and a[0] != b[0]:
                found.append((-score, b[2] is None, [-ord(c) for c in b[2] or ""], [-ord(c) for c in b[1]], b[0]))
        for rank, f in enumerate(sorted(found)[:limit], 1):
            out[a[0], rank] = (f[-1], float(-f[0]), len(found))
    return out


@pytest.mark.parametrize("types,block", [(2, 2048), (30, 7), (200, 5)])
def test_all_cases_against_plain_loops(spark, types, block, monkeypatch):
    """Common types, and types with too few cases, whose cases look at all others too; blocks of few signatures meet in several tasks."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(types)
    rows = []
    for k in range(160):
        kind = None if rng.random() < 0.1 else "" if rng.random() < 0.05 else f"t{rng.randrange(types)}"
        text = " ".join(rng.sample(RULES.lexicon, rng.randrange(0, 4))) if rng.random() < 0.7 else ""
        rows.append((k, f"N{rng.randrange(99):03d}", rng.choice(["1", "2", None]), kind, rng.choice(["x", "y", None]), rng.choice(["c", "d", ""]), text))
    schema = "case_id long, case_number string, decision_date string, dispute_type string, decision_result string, decision_category string, text string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    signed = similar.signatures(df, df.text, RULES)
    want = brute(rows, 4)
    got = {(r.case_id, r["rank"]): (r.similar_id, r.score, r.total_candidates) for r in similar.similar_cases_topk(signed, None, 4, RULES).collect()}
    assert got == want
    some = df.where("case_id % 9 = 0").select("case_id")
    got = {(r.case_id, r["rank"]): (r.similar_id, r.score, r.total_candidates) for r in similar.similar_cases_topk(signed, some, 4, RULES).collect()}
    assert got == {k: v for k, v in want.items() if k[0] % 9 == 0}


def test_rules_without_a_decisive_type_are_refused(spark):
    with pytest.raises(ValueError, match="common type"):
        similar.similar_cases_topk(None, None, 5, Similarity(same_type=40))


def test_blocks_are_compared_in_steps():
    """Two blocks of 2048 rows met as one matrix of eight bytes a pair and several copies of it, from an object for each row."""
    for left, right in ((2048, 2048), (5000, 1), (3, 1 << 20), (1, 0)):
        steps = [range(left)[s] for s in similar._steps(left, right)]
        assert [k for s in steps for k in s] == list(range(left))
        assert all(len(s) == 1 or len(s) * right <= similar.CELLS for s in steps)
    rows = pa.array([[{"a": 1, "b": "x"}, {"a": 2, "b": None}], [{"a": 3, "b": "y"}]])
    got = [(x.to_pydict(), y["a"].to_pylist()) for x, y in similar._block_pairs(pa.record_batch({"left": rows, "right": rows}))]
    assert got == [({"a": [1, 2], "b": ["x", None]}, [1, 2]), ({"a": [3], "b": ["y"]}, [3])]
