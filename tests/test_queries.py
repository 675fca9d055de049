"""Every registered query that has a DuckDB counterpart, row by row at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if pd.isna(value):
        return None
    if hasattr(value, "year"):
        return str(pd.Timestamp(value))
    return value if isinstance(value, str) else bool(value) if str(value) in ("True", "False") else float(value)


def ordered(frame: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(plain, row)) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert ordered(ours) == ordered(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
