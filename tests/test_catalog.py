"""Every query with SQL gives DuckDB's rows at the smallest scale; the others run."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusforge import catalog

catalog.load()


def cell(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(cell(y) for y in x)
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else round(float(x), 6)
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    return int(x) if isinstance(x, (int, np.integer)) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(cell(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, sf_dir, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - {"answer_adaptive"}))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
