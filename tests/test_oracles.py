"""Every query of the engine with SQL beside it gives the same rows in DuckDB."""

import math
import os

import duckdb
import pytest

from loomwright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), [d[0] for d in want.description])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).columns
    registry.QUERIES[name](spark, SF).collect()
