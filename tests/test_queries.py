"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

from __future__ import annotations

import datetime

import duckdb
import pandas as pd
import pytest

from lakedocs import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if pd.isna(v):
            return ""
        if isinstance(v, datetime.date):  # of a time at midnight, too: DuckDB's frames have no dates
            return str(v).removesuffix(" 00:00:00")
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            return repr(round(float(v), 5))
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    ours = catalog.queries()[name](spark, sf).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert rows(ours) == rows(duck.sql(sql).df())
    else:
        assert len(ours) and len(ours.columns)


def test_sql_has_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert catalog.FLAGSHIP in catalog.queries()
