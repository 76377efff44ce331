"""The driver's contract: every query runs, and equals its SQL where it has one."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from corpusloom.plans import registry

D = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(v[i]) for i in order] for v in values), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, D)
    if name not in registry.ORACLES:
        assert got.columns and got.count() >= 0
        return
    con = duckdb.connect()
    for f in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
