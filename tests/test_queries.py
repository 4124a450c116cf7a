"""Every query with a DuckDB equivalent gives the same rows."""

import duckdb
import pytest

from paraqa.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "pages", "benchmark", "conversations")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr(tuple(r[k] for k in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_ordered_results_are_ordered(spark):
    kinds = [r.kind for r in plans.QUERIES["report_items"](spark, SF).collect()]
    assert kinds == sorted(kinds, key=("check", "english", "fixed", "manual").index)
