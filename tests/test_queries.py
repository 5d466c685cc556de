"""Every registered query against its SQL twin on the smallest tables."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as driver
from counterpoise.queries import ORACLE, QUERIES

FOLDER = driver.SMOKE_DIR
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert QUERIES.items() <= driver.queries().items()
    assert ORACLE.items() <= driver.oracle_sql().items()


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["id", "p_size", "p_retailprice", "p_type", "label", "origin"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = collections.Counter(
        tuple(repr(r[c]) for c in columns) for r in df.collect())
    cursor = sql.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = collections.Counter(tuple(repr(r[i]) for i in at) for r in cursor.fetchall())
    assert found == expected
