"""Every registered query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from catalogue.oracle import ORACLE
from catalogue.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def in_order(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted([tuple(r[i] for i in at) for r in rows], key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert in_order(df.columns, [tuple(r) for r in df.collect()]) == in_order(columns, result.fetchall())


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= contract.queries().keys()


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "LGA_NAME19", "LGA_CODE_2019", "FIRESEASON", "FIRETYPE", "FIRECOUNT", "AREAHA"
    ]
