"""Every query of the catalogue against its SQL on the smallest tables, as multisets of rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from treeloom.plans import catalog

SF = os.environ.get("TREELOOM_SF_DIR", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if v is None or pd.isna(v):
        return None
    return int(v) if isinstance(v, float) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    mine, theirs = catalog.queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    rows = lambda df: sorted(repr(tuple(map(plain, r))) for r in df[columns].itertuples(index=False))
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
