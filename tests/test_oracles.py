"""Every registered query with SQL equals DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from gradus.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted(names) == cols
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if a != b and not all(x == y or isinstance(x, float) and isinstance(y, (float, int)) and abs(x - y) < 2e-5 for x, y in zip(a, b))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
