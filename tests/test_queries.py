"""Every registered query against its SQL in another engine."""

import pytest

import __spark_entry__ as entry
from forumgauge.catalog.check import check, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    rows, difference, _ = check(spark, duck, QUERIES[name], SQL.get(name), folder)
    assert not difference
    assert rows > 0 or name in ("contains_term",)


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, folder):
    report = entry.entry(spark)
    assert report.columns == ["video_id", "title", "date", "view_count", "n", "prop_offense", "rolling_mean"]
    assert report.count() > 0
