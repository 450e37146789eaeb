"""Views of the driver's star-schema tables in the shapes the library reads.

The reference reads monthly climate series ``(location, date yyyymm, value)``
and declaration records ``(state, incident_type, fy_declared)``.  The test
data are TPC-H-like tables, so each source shape is a Spark view over them:

* climate series: ``orders ⋈ customer ⋈ nation``; ``location = n_name``,
  ``date = yyyyMM(o_orderdate)``, ``value = o_totalprice``.
* declarations: ``lineitem ⋈ supplier``; ``state`` = code of the supplier's
  nation, ``incident_type = l_returnflag || l_linestatus``,
  ``fy_declared = year(l_shipdate)``.
* places: ``nation``; code ``'N' || lpad(n_nationkey, 2, '0')``, region from
  ``n_regionkey`` (key 4 is on no list, so those places get no region).

Every row of the tables is used.  Places of a finer grain are the customers:
their orders give one series by order date, and the lines of those orders three
series and the declarations by ship date.  A customer's order years and ship
years differ by themselves, so some place-years have no match there.

Every view takes the year range it will be filtered to and applies it to the
raw timestamp as well.  That second copy of the filter is what reaches the
Parquet scan (``PushedFilters``): the year the operators filter on is
derived from text, which no scan can prune on.  Results are unchanged.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the mapping (see module docstring).
DRIVER_YEARS = (1953, 2018)  # the reference's period, which spans the data
REGION_BY_REGIONKEY = {0: "southeast", 1: "northeast", 2: "west", 3: "midwest"}
# Four of the six incident types, standing in for storm/drought/fire/flood.
PANEL_TYPES = ["AF", "NF", "NO", "RO"]


# Declared schemas of the driver tables read here (FIXTURES.md §4): the
# reader then skips schema inference, which opens every file footer.
TABLE_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read with its declared schema; its files are listed anew at each call."""
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts_range(col: str, years: tuple[int, int] | None):
    if years is None:
        return F.lit(True)
    lo, hi = years
    return ((F.col(col) >= F.lit(dt.datetime(lo, 1, 1)).cast("timestamp_ntz"))
            & (F.col(col) < F.lit(dt.datetime(hi + 1, 1, 1)).cast("timestamp_ntz")))


def nation_code(key_col: str) -> F.Column:
    return F.concat(F.lit("N"), F.lpad(F.col(key_col).cast("string"), 2, "0"))


def nation_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places dimension ``(location, state_code, region)`` from ``nation``.

    Its size is that of the nation table; joins against it are left to the
    planner's size check (``autoBroadcastJoinThreshold``) rather than forced.
    """
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("location"),
        nation_code("n_nationkey").alias("state_code"),
        _region_of_key(F.col("n_regionkey")).alias("region"),
    )


def _region_of_key(key: F.Column) -> F.Column:
    region = F.lit(None).cast("string")
    for k in sorted(REGION_BY_REGIONKEY, reverse=True):
        region = F.when(key == k, F.lit(REGION_BY_REGIONKEY[k])).otherwise(region)
    return region


def climate_raw(spark: SparkSession, sf_dir: str,
                years: tuple[int, int] | None = DRIVER_YEARS) -> DataFrame:
    """Monthly-series shape ``(location, date, value)`` from orders."""
    orders = (table(spark, sf_dir, "orders")
              .where(_ts_range("o_orderdate", years))
              .select("o_custkey", "o_orderdate", "o_totalprice"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, F.col("c_nationkey") == nation.n_nationkey)
            .select(F.col("n_name").alias("location"),
                    F.date_format("o_orderdate", "yyyyMM").alias("date"),
                    F.col("o_totalprice").alias("value")))


def declarations_raw(spark: SparkSession, sf_dir: str,
                     years: tuple[int, int] | None = DRIVER_YEARS,
                     weighted: bool = False) -> DataFrame:
    """Declaration-record shape ``(state, incident_type, fy_declared)``.

    ``weighted=True`` gives the same records already counted per supplier,
    type and year (column ``n_records``): the line items are reduced before
    the supplier join (partial aggregation on the map side), so the join and
    its shuffle carry one row per supplier-type-year instead of one per line,
    and a supplier holding a third of the lines leaves each map task as a
    handful of rows.
    """
    lines = (table(spark, sf_dir, "lineitem")
             .where(_ts_range("l_shipdate", years))
             .select("l_suppkey",
                     F.concat("l_returnflag", "l_linestatus").alias("incident_type"),
                     F.year("l_shipdate").alias("fy_declared")))
    if weighted:
        lines = (lines.groupBy("l_suppkey", "incident_type", "fy_declared")
                 .agg(F.count(F.lit(1)).alias("n_records")))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    extra = ["n_records"] if weighted else []
    return (lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)
            .select(nation_code("s_nationkey").alias("state"), "incident_type", "fy_declared", *extra))


def order_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-level rows for the count models at scale.

    ``y`` = total quantity of the order's lines (over-dispersed counts),
    ``n_lines`` = its number of lines (under-dispersed), regressors: order
    year, the customer's region (null for unlisted places) and total price.
    Line items are reduced to one row per order before any join.
    """
    per_order = (table(spark, sf_dir, "lineitem")
                 .groupBy("l_orderkey")
                 .agg(F.sum(F.col("l_quantity").cast("long")).alias("y"),
                      F.count(F.lit(1)).alias("n_lines")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    regions = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey"), _region_of_key(F.col("n_regionkey")).alias("region"))
    rows = (per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
            .join(customer, F.col("o_custkey") == customer.c_custkey)
            .join(regions, F.col("c_nationkey") == regions.n_nationkey, "left"))
    return rows.select(F.col("l_orderkey").alias("order_key"), "y", "n_lines",
                       F.year("o_orderdate").alias("year"), "region",
                       F.col("o_totalprice").alias("totalprice"))


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places: ``(location, state_code, region)``."""
    regions = table(spark, sf_dir, "nation").select("n_nationkey", _region_of_key(F.col("n_regionkey")).alias("region"))
    customer = table(spark, sf_dir, "customer")
    return customer.join(regions, customer.c_nationkey == regions.n_nationkey, "left").select(
        F.col("c_name").alias("location"), customer_code("c_custkey").alias("state_code"), "region")


def customer_code(key_col: str) -> F.Column:
    return F.concat(F.lit("C"), F.col(key_col).cast("string"))


def customer_series(spark: SparkSession, sf_dir: str,
                    years: tuple[int, int] | None = DRIVER_YEARS) -> dict[str | tuple[str, ...], DataFrame]:
    """Four separate series by customer: order totals by order date; line prices, quantities and discounts by
    ship date.  The last three are columns of one table, so that lines meet their orders once."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders")
    by_order = orders.where(_ts_range("o_orderdate", years)).join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_name").alias("location"), F.date_format("o_orderdate", "yyyyMM").alias("date"),
        F.col("o_totalprice").alias("value"))
    owner = orders.select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == customer.c_custkey).select("o_orderkey", "c_name")
    lines = table(spark, sf_dir, "lineitem").where(_ts_range("l_shipdate", years))
    by_line = lines.join(owner, lines.l_orderkey == owner.o_orderkey).select(
        F.col("c_name").alias("location"), F.date_format("l_shipdate", "yyyyMM").alias("date"),
        F.col("l_extendedprice").alias("pcp"), F.col("l_quantity").alias("tmax"), F.col("l_discount").alias("tmin"))
    return {"tavg": by_order, ("pcp", "tmax", "tmin"): by_line}


def customer_declarations(spark: SparkSession, sf_dir: str,
                          years: tuple[int, int] | None = DRIVER_YEARS) -> DataFrame:
    """Declarations by customer, already counted per order, type and ship year (``n_records``)."""
    lines = (table(spark, sf_dir, "lineitem").where(_ts_range("l_shipdate", years))
             .groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("incident_type"),
                      F.year("l_shipdate").alias("fy_declared"))
             .agg(F.count(F.lit(1)).alias("n_records")))
    owner = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(owner, lines.l_orderkey == owner.o_orderkey).select(
        customer_code("o_custkey").alias("state"), "incident_type", "fy_declared", "n_records")
