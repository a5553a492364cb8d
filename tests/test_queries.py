"""Every registered query of the library against its SQL, on the small tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from chatloom.plans import catalogue


def _rows(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return sorted(tuple("NULL" if pd.isna(v) else str(v) for v in row) for row in df[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))


def test_no_training_data_imports():
    for path in glob.glob(os.path.join(os.path.dirname(catalogue.__file__), "..", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in os.path.normpath(path):
            assert "chatloom.llm" not in open(path).read(), path
