"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from wardlight.plans import checks, cities, composites, feeds, forms, geometry, texts  # noqa: F401  register their queries
from wardlight.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def cell(x):
    if isinstance(x, (list, np.ndarray)):
        return tuple(cell(y) for y in x)
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (int, float, np.number, np.bool_)):
        return float(x)
    return str(x).removesuffix(" 00:00:00")


def rows(df):
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows(spark, oracle, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), oracle.execute(Q.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
