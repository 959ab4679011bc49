"""Every query against its SQL on DuckDB. ``$ORACLE_SF_DIR`` picks the tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from fluxlake.catalog.oracles import ORACLES
from fluxlake.catalog.queries import QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if frame[name].dtype.kind == "M":
            frame[name] = frame[name].astype("datetime64[us]")
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    got, want = rows(QUERIES[name](spark, SF).toPandas()), rows(tables.sql(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for column in got.columns:
        assert got[column].dtype.kind == want[column].dtype.kind, column
        equal = (got[column] == want[column]) | (got[column].isna() & want[column].isna())
        assert equal.all(), (column, got[column][~equal].head(3).tolist(), want[column][~equal].head(3).tolist())
