"""Every query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr([r[names.index(c)] for c in cols]) for r in cur.fetchall())
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want


def test_every_query_is_named():
    assert set(oracle_sql()) <= set(queries())
