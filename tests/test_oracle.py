"""Every query that has SQL gives the rows of its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from pagemill.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def canon(df):
    df = df[sorted(df.columns)].map(lambda v: tuple(v) if isinstance(v, (list, np.ndarray)) else v)
    rows = [tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)]
    return sorted(df.columns), sorted(rows, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    assert canon(QUERIES[name](spark, DATA).toPandas()) == canon(duck.execute(ORACLE_SQL[name]).df())
