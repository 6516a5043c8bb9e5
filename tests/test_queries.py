"""The registered queries of the library against their SQL twins, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import queryset
from check_queries import TABLES, table

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(queryset.ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    answer = db.execute(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in answer.description], answer.fetchall())
