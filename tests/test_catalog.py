"""Every registered query against its SQL, by value and by kind of type; every row must be able to fail."""

import decimal
import os

import duckdb
import pytest

from loomlake.plans.catalog import QUERIES, SQL, TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Rows that have no SQL form: they must give rows, and have tests of their own.
WITHOUT_SQL = {"r013_page_blocks", "r025_incremental_shipping", "r130_head_and_tail", "r138_fuzzy_rank", "r175_tail_replay", "r193_plugin_rules"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    """Values that tell kinds apart: truths, whole numbers, other numbers, texts, times."""
    if v is None or isinstance(v, (bool, str)):
        return (type(v).__name__, v)
    if isinstance(v, (int, float, decimal.Decimal)):
        whole = v == v.to_integral_value() if isinstance(v, decimal.Decimal) else float(v).is_integer() and not isinstance(v, float)
        return ("number", int(v) if isinstance(v, int) or whole and isinstance(v, decimal.Decimal) else round(float(v), 9))
    return (type(v).__name__, str(v))


def rows(columns, records):
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[k]) for k in at) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF), db.sql(SQL[name])
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found == rows(want.columns, want.fetchall())
    assert found[1], "a row without rows proves nothing"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert name in WITHOUT_SQL and QUERIES[name](spark, SF).count() > 0


def test_all_rows_of_the_inventory():
    assert {int(n[1:4]) for n in QUERIES if n[0] == "r"} == set(range(1, 214))
