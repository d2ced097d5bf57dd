"""Every registered query of the library against its SQL on DuckDB, over the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidewater import queries as q
from tidewater import queries_more, queries_programs  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in q.tables.PARQUET:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def rows(df, columns):
    return sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    ours = q.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(q.ORACLE_SQL[name]).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert rows(ours, columns) == rows(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0
