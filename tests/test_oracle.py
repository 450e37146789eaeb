"""Registered queries against their DuckDB statements on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from galecast.plans.catalog import all_queries
from galecast.plans.oracle import oracle_queries
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, frame_hash


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


SQL = oracle_queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    got = all_queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert frame_hash(got) == frame_hash(want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["region", "year", "ave_temp", "sum_precip", "count_region"]
    assert df.count() >= 0


def test_four_series_drop_place_years(spark):
    """Customers' order years and ship years differ, so the rule "in all four series" has something to drop."""
    from galecast.operators.climate import with_year
    from galecast.sources import tables
    series = tables.customer_series(spark, SF_SMALL)
    keys = [with_year(df, tables.DRIVER_YEARS).select("location", "year").distinct() for df in series.values()]
    everything = keys[0].unionByName(keys[1]).distinct().count()
    assert 0 < all_queries()["climate_four_series"](spark, SF_SMALL).count() < everything
    fact = all_queries()["fact_by_customer"](spark, SF_SMALL)
    assert fact.where("location IS NULL").count() > 0  # declarations without climate


def test_every_row_is_used(spark):
    from galecast.sources import tables
    t = lambda name: tables.table(spark, SF_SMALL, name).count()
    assert tables.climate_raw(spark, SF_SMALL).count() == t("orders")
    assert tables.declarations_raw(spark, SF_SMALL).count() == t("lineitem")
