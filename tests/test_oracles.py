"""Every registered query against its SQL in DuckDB, and the entry contract."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical
from conftest import SF_DIR


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows = df.collect()
    if name in entry.oracle_sql():
        found = duck.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(df.columns, rows) == canonical(columns, found.fetchall())
    else:
        assert rows


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:5] == ["dow", "window_no", "start_min", "end_min", "n_cont"]
    assert df.count() > 0
