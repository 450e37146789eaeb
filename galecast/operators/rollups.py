"""Regional rollups and the type × region table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import drop_any_null, na_max, na_mean, na_sum, not_na_text
from ..sources.dims import REGION_ORDER


def regional_rollup(fact_a: DataFrame, dedupe: bool = False,
                    by: Sequence[str] = ()) -> DataFrame:
    """Region-year table ``region, year, ave_temp, sum_precip, count_region``.

    ``dedupe=False`` is the published form: the fact table repeats a
    place-year once per disaster type, and the mean and sum run over those
    repeats, so climate is weighted by the number of types (defect D1).
    ``dedupe=True`` first reduces to one row per place-year.

    The region filter is on a grouping key, so it runs before the shuffle.
    ``by`` adds grouping keys in front (``["disaster"]`` gives A7).
    """
    keys = [*by, "region", "year"]
    rows = fact_a.where(not_na_text("region"))
    for k in by:
        rows = rows.where(not_na_text(k))
    if dedupe:
        rows = (rows.groupBy(*keys, "location")
                .agg(na_max("mean_temp").alias("mean_temp"),
                     na_max("total_precip").alias("total_precip"),
                     na_sum("n_disaster_state").alias("n_disaster_state")))
    return (rows.groupBy(*keys)
            .agg(na_mean("mean_temp").alias("ave_temp"),
                 na_sum("total_precip").alias("sum_precip"),
                 na_sum("n_disaster_state").alias("count_region"))
            .select(*keys, "ave_temp", "sum_precip", "count_region"))


def regional_type_rollup(fact_a: DataFrame) -> DataFrame:
    """Region-year-type table (A7): ``disaster`` + the regional columns."""
    return regional_rollup(fact_a, by=["disaster"])


def type_totals_wide(fact_a: DataFrame, regions: Sequence[str] = REGION_ORDER) -> DataFrame:
    """One row per disaster type, one total column per region.

    Only fact rows with no missing column count (the reference drops them
    before summing).  One scan and one aggregate; the pivot values are
    given, so Spark does not run a job to find them.
    """
    complete = drop_any_null(fact_a)
    return (complete.where(F.col("region").isin(list(regions)))
            .groupBy("disaster").pivot("region", list(regions))
            .agg(F.sum("n_disaster_state")))


def type_by_region(fact_a: DataFrame, published: bool = False,
                   regions: Sequence[str] = REGION_ORDER) -> DataFrame:
    """Totals by type × region in long form, largest first.

    The reference builds four per-region tables and glues them with left
    joins: the last region is joined onto the third, and both onto the first.
    So a type never seen in the first region is lost, and one never seen in the
    third loses its total in the last as well (defect D7).  ``published=True``
    gives exactly that; the default keeps every total.  Either way a missing region total stays null, and the
    sort puts nulls last with type and region as tie-breaks.
    """
    wide = type_totals_wide(fact_a, regions)
    if published:
        chained = F.when(F.col(regions[2]).isNotNull(), F.col(regions[3]))
        wide = wide.where(F.col(regions[0]).isNotNull()).withColumn(regions[3], chained)
    long = wide.unpivot(["disaster"], list(regions), "region", "n_disaster")
    return long.orderBy(F.desc_nulls_last("n_disaster"), F.asc("disaster"), F.asc("region"))
