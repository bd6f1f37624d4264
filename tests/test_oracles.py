"""Every query against its SQL statement, value by value."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield con
    con.close()


def canonical(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(value):
        return None if isinstance(value, float) and math.isnan(value) else value

    out = [tuple(cell(r[i]) for i in order) for r in records]
    return [names[i] for i in order], sorted(out, key=lambda r: [(v is not None, str(type(v)), v) if v is not None
                                                                 else (False, "", 0) for v in r])


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, duck, key):
    frame = queries()[key](spark, SF_DIR)
    relation = duck.execute(oracle_sql()[key])
    expected = canonical([c[0] for c in relation.description], relation.fetchall())
    actual = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    assert actual[0] == expected[0]
    assert len(actual[1]) == len(expected[1]) > 0
    assert actual[1] == expected[1]


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["zona", "item", "level", "ordinal", "count", "percent"]
    assert frame.count() > 0
