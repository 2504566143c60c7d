"""Every query of the catalog against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from roadloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str([plain(x) for x in r]) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, name):
    got = rows(catalog.queries()[name](spark, SF).toPandas())
    if name in catalog.oracle_sql():
        connection = duckdb.connect()
        for table in TABLES:
            connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
        assert got == rows(connection.execute(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
