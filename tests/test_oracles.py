"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from callweft.plans import catalog

#: Queries without rows at the smallest scale.
EMPTY_WHEN_TINY = {"literal_flow_single_assign"}
SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v is pd.NA or v != v else str(int(v) if isinstance(v, float) and v == int(v) else v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_duckdb(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(want) or name in EMPTY_WHEN_TINY
