"""Every registered query with SQL agrees with it on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from pulseloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
CORE = sorted(SQL.keys() & catalogue.queries().keys())


def canonical(df):
    df = df[sorted(df.columns)].astype(object)
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False, name=None)]
    return list(df.columns), sorted(rows, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    columns, ours = canonical(entry.queries()[name](spark, DATA).toPandas())
    expected_columns, expected = canonical(duck.sql(SQL[name]).df())
    assert columns == expected_columns
    assert len(ours) == len(expected)
    for a, b in zip(ours, expected):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, (int, float)) for x in a) else a == b


def test_entry(spark):
    assert entry.entry(spark).columns == ["session", "segment", "frame", "waveform_length"]
