"""Every query that has SQL gives the SQL's rows, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from ledgerspark.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        one = []
        for v in r:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
                one.append(None)
            elif isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb":
                one.append(round(float(v), 6))
            else:
                one.append(str(v)[:10] if hasattr(v, "year") else str(v))
        out.append(tuple(one))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, data, duck, name):
    a, b = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0
