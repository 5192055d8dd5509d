"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from tidemark.plans.queries import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same_as_duckdb(duck, frame, sql):
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert as_rows(frame.columns, [tuple(r) for r in frame.collect()]) == as_rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    same_as_duckdb(duck, QUERIES[name](spark, SF_DIR), ORACLE_SQL[name])


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_statements_come_back(spark):
    made = QUERIES["statement_split"](spark, SF_DIR)
    from tidemark.plans.queries import order_changes
    from tidemark.functions.dialects import MYSQL
    from tidemark.operators.render import change_sql

    want = [s.rstrip(";") for r in order_changes(spark, SF_DIR).orderBy("tx_id", "lsn").select(change_sql(MYSQL).alias("s")).collect() for s in r.s.split(";\n")]
    assert sorted(r.statement for r in made.collect()) == sorted(want)
