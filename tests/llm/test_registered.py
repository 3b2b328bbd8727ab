import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
from ambilens.llm.queries import LLM_ORACLES
from check_oracles import counted

TABLES = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = contract.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_like_its_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        db.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    df = contract.queries()[name](spark, TABLES)
    found = db.execute(contract.oracle_sql()[name])
    columns = [item[0] for item in found.description]
    theirs = counted(columns, found.fetchall())
    assert sorted(columns) == sorted(df.columns) and theirs
    assert counted(df.columns, [tuple(row) for row in df.collect()]) == theirs
