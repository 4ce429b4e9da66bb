"""Every registered query against its SQL check on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from bindings import MODULES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def test_every_query_has_a_check():
    registered = {name for module in MODULES for name in module.QUERIES}
    assert registered <= set(QUERIES)
    assert registered <= set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "brand", "model_name", "card_count", "not_downloaded_count", "estimated_fleet_size", "bundle_priority",
    ]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    columns = sorted(df.columns)
    order = [[d[0] for d in result.description].index(c) for c in columns]
    expected = sorted(repr([row[i] for i in order]) for row in result.fetchall())
    assert sorted(repr([row[c] for c in columns]) for row in df.collect()) == expected
