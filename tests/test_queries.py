"""Every registered query with SQL against DuckDB on the small tables, and the others for rows and a schema."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from lodespark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def normal(df):
    out = df[sorted(df.columns)].copy()
    for c in out:
        out[c] = out[c].astype(float).round(6) + 0.0 if out[c].dtype.kind in "fiu" else out[c].astype(str)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(rows.columns) == sorted(want.columns)
        assert normal(rows).equals(normal(want))


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
