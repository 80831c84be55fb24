"""Every query with SQL against DuckDB on the same tables, and the plans' shape."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from jobweave.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in os.listdir(small):
        c.execute(f"create view {t[:-8]} as select * from '{small}/{t}'")
    return c


def canon(df):
    def cell(x):
        if hasattr(x, "tolist") and not isinstance(x, pd.Timestamp):
            return x.tolist()
        if not isinstance(x, (list, tuple)) and pd.isna(x):
            return None
        return int(x) if isinstance(x, float) and x.is_integer() else x

    df = df[sorted(df.columns)].astype(object)
    return sorted(str(tuple(map(cell, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, small, name):
    got, want = registry.queries()[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["posting_id", "title", "date_posted"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_without_llm():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "jobweave.llm" in p.read_text()]
