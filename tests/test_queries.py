"""Every query against its SQL on the smallest tables, where they are there."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from orbweave import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
        return "-"
    if isinstance(x, (float, np.floating)):
        x = round(float(x), 5)
        return str(int(x)) if x == int(x) else str(x)
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    return str(pd.Timestamp(x)) if type(x).__name__ in ("date", "datetime", "Timestamp", "datetime64") else str(x)


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(x) for x in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_as_sql(spark, duck, name):
    found, want = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert canonical(found) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    """Queries beyond SQL give rows, and the same ones again; their operators' values are tested on fixtures."""
    first = catalog.queries()[name](spark, DATA).toPandas()
    assert len(first) > 0 and canonical(first) == canonical(catalog.queries()[name](spark, DATA).toPandas())


def test_entry(spark):
    assert catalog.flagship(spark, DATA).columns == ["label", "basis", "n"]
