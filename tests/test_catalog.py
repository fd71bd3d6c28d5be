"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from loomline.plans import catalog, planted

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


QUERIES = catalog.queries() | planted.queries()
SQL = catalog.oracle_sql() | planted.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert shown(df.columns, df.collect()) == shown(want.columns, want.fetchall())


def test_every_query_but_the_model_has_sql():
    assert set(QUERIES) - set(SQL) == {"score_udf"}
    assert not set(catalog.queries()) & set(planted.queries())


def test_planted_rows_are_met(spark):
    """Queries of rules find something, and most of their rules."""
    for name in [n for n in planted.queries() if n.startswith("dq_")]:
        assert not QUERIES[name](spark, FOLDER).isEmpty(), name


def test_plans_push_filters_and_prune_columns(spark):
    plan = catalog.queries()["label_counts"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line and "documents" in line]
    assert scans and all("n_chars" not in line.split("ReadSchema")[1] for line in scans)
    pending = catalog.queries()["pending_texts"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in pending and "Cartesian" not in pending
