"""Registered queries of the training-data operators against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import TABLES, compare
from prepspark.llm.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0
