"""The fact table: climate measures ⟗ declaration counts.

Two variants exist in the reference and give different numbers:

* **A, joined-then-counted**: full join first, missing counts become 0,
  totals are summed over the joined table.  Rows without climate data have
  no ``location`` and are pooled into one ``n_state`` group per year.
* **B, counted-then-joined**: totals are summed on the declarations first,
  then joined; a place-year with no declaration keeps null counts and
  territories keep their own totals.  No region column.

The join keys are ``(year, state_code) = (year, state)`` with null matching
null.  Both sides are reduced to place-year grain before the join, so the
full join runs on tables bounded by places × years (× types), never on raw
records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import null_safe_on
from .hazards import with_totals

MEASURE_COLS = ["mean_temp", "total_precip", "max_temp", "min_temp"]


def _full_join(climate: DataFrame, counts: DataFrame, count_cols: list[str]) -> DataFrame:
    c, d = climate.alias("c"), counts.alias("d")
    cond = null_safe_on(c, d, [("year", "year"), ("state_code", "state")])
    return c.join(d, cond, "full").select(
        F.coalesce(F.col("c.state_code"), F.col("d.state")).alias("state_code"),
        F.col("c.location").alias("location"),
        F.coalesce(F.col("c.year"), F.col("d.year")).alias("year"),
        *[F.col(f"c.{m}").alias(m) for m in MEASURE_COLS],
        F.col("d.disaster").alias("disaster"),
        *[F.col(f"d.{x}").alias(x) for x in count_cols],
    )


def attach_region(df: DataFrame, places: DataFrame) -> DataFrame:
    """Region label by place name; names on no list (or null) get null."""
    return df.join(places.select("location", "region"), on="location", how="left")


FACT_A_COLS = ["state_code", "location", "year", *MEASURE_COLS, "disaster",
               "n_disaster_state", "n_state", "n_total", "n_type", "region"]
FACT_B_COLS = ["state_code", "location", "year", *MEASURE_COLS, "disaster",
               "n_disaster_state", "n_state", "n_total", "n_type"]


def fact_joined_then_counted(climate: DataFrame, counts: DataFrame,
                             places: DataFrame, bounded: bool = True) -> DataFrame:
    """Variant A (the statistical page, the summary page and the dashboard)."""
    joined = _full_join(climate, counts, ["n"]).withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("long")))
    return attach_region(with_totals(joined, "location", bounded=bounded), places).select(*FACT_A_COLS)


def fact_counted_then_joined(climate: DataFrame, totals: DataFrame) -> DataFrame:
    """Variant B (the map app and the report): totals from ``declaration_totals``."""
    return _full_join(climate, totals,
                      ["n_disaster_state", "n_state", "n_total", "n_type"]).select(*FACT_B_COLS)


def dashboard_fact(fact_a: DataFrame) -> DataFrame:
    """Variant A as the dashboard names it: ``location`` becomes ``state``."""
    return fact_a.withColumnRenamed("location", "state")
