"""Every query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

from conftest import SMALL
from repoloom.plans.oracle import ORACLE_SQL
from repoloom.plans.queries import QUERIES, flagship

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())
    assert got == want
    assert got or name == "t3_node_at"


def test_tag_counts_of_the_small_corpus(spark):
    counts = {r["tag"]: r["files"] for r in flagship(spark, SMALL).collect()}
    assert counts == {
        "ai": 7, "api": 9, "config": 27, "data": 8, "docs": 17, "flask": 6, "logging": 9,
        "python": 12, "react": 18, "sql": 12, "styles": 11, "test": 10, "validation": 9,
        "vue": 12, "yaml": 11,
    }
