"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_proofs import TABLES, rows_of
from unitloom.proofs import PROOFS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for name in TABLES:
        made.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return made


def test_every_query_has_sql():
    """Of the queries that always register; the others bring tests of their own where SQL cannot express them."""
    assert all(sql is not None for _, sql in PROOFS.values())
    assert set(PROOFS) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1700
