"""Every query that SQL can express against DuckDB, at the smallest scale."""

from __future__ import annotations

import glob
import os

import numpy as np
import pytest
from conftest import SMALL

from rollumen.queries import basics, benchmarks, flow, policy, records, sequences, streams, tables, text

FAMILIES = (policy, tables, text, flow, records, sequences, streams, benchmarks, basics)
QUERIES = {n: f for m in FAMILIES for n, f in m.QUERIES.items()}
ORACLES = {n: s for m in FAMILIES for n, s in m.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        numbers = df[c].dropna().map(lambda x: isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_))).all()
        if df[c].dtype.kind in "iuf" or (df[c].dtype == object and numbers):  # whole numbers with nulls come as either
            df[c] = df[c].astype(float).round(6) + 0.0
    text = df.astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan"})
    return text.sort_values(list(text.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    assert plain(ours).equals(plain(theirs))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 1
    assert set(e.oracle_sql()) <= set(e.queries())
