"""Registered queries beside their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from ambilens.plans.oracles import ORACLES
from ambilens.plans.queries import QUERIES
from check_oracles import counted

TABLES = contract.SMOKE_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = contract.queries()[name](spark, TABLES)
    found = db.execute(contract.oracle_sql()[name])
    columns = [item[0] for item in found.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = counted(columns, found.fetchall())
    assert counted(df.columns, [tuple(row) for row in df.collect()]) == theirs
    assert theirs


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["source_index", "n_pairs"] and found.count() > 0
