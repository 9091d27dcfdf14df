import importlib.util
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from caselake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def shown(x):
        if isinstance(x, (list, np.ndarray)):
            return str([shown(y) for y in x])
        if x is None or (not isinstance(x, (str, bytes)) and pd.isna(x)):
            return "null"
        return f"{float(x):.6g}" if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(shown(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_optional_subpackage():
    top = os.path.dirname(importlib.util.find_spec("caselake").origin)
    for folder, _, names in os.walk(top):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, n), encoding="utf-8").read()
