"""Chart-ready tables and parameterised slices.

Each function returns the tidy table one chart of the reference consumes;
drawing is not done here.  The interactive inputs of the two apps become
function arguments, so a slice is an ordinary filter that Catalyst pushes
down (and, on a table written partitioned by the filtered column, prunes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import drop_any_null, not_na_text
from ..functions.text import paste, r_round, str_c

# Labels the map app gives its five variables, in its order.
MAP_LABELS = {
    "mean_temp": "Yearly Mean Temperature (degrees F)",
    "max_temp": "Yearly Maximum Temperature (degrees F)",
    "min_temp": "Yearly Minimum Temperature (degrees F)",
    "mtotal_precip": "Yearly Total Precipitation (inches)",
    "mn_state": "Yearly Total of All Disasters",
}


def num_label(c) -> F.Column:
    """A number as text the way the reference prints it inside labels:
    15 significant digits, no trailing zeros or point in front of an exponent."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.format_string("%.15g", c.cast("double"))
    mantissa, exponent = F.regexp_extract(text, r"^([^e]*)", 1), F.regexp_extract(text, r"(e.*)$", 1)
    mantissa = F.when(mantissa.contains("."), F.regexp_replace(mantissa, r"\.?0+$", "")).otherwise(mantissa)
    return F.concat(mantissa, exponent)


# The texts inside the labels below are those of the reference's charts.


def precip_points(fact_a: DataFrame, published: bool = True) -> DataFrame:
    """Precipitation scatter by region, with hover label (C4).

    The published table keeps the hidden group key ``disaster`` in the
    ``distinct`` (defect D5), so a point repeats once per type.
    """
    keys = ["disaster", "region", "year", "total_precip"] if published else ["region", "year", "total_precip"]
    pts = drop_any_null(fact_a).select(*keys).distinct()
    return pts.withColumn("text_label", str_c(num_label("year"), "\nTotal Precip(in.):",
                                              num_label("total_precip")))


def temp_points(fact_a: DataFrame) -> DataFrame:
    """Temperature scatter by region (C5 points; the trend is stats.smooth)."""
    return drop_any_null(fact_a).select("region", "year", "mean_temp")


def type_panel(regional_type: DataFrame, types: Sequence[str]) -> DataFrame:
    """Yearly count by region for a few disaster types."""
    return (regional_type.select("region", "disaster", "year", F.col("count_region").alias("total"))
            .dropna(how="any")
            .where(F.col("disaster").isin(list(types))))


def region_year_bars(fact_a: DataFrame) -> DataFrame:
    """Stacked bars per region-year with label, as published.

    ``distinct`` runs over (type, count, region, year), so two places of one
    region with the same count for the same type merge (defect D6).
    """
    bars = drop_any_null(fact_a).select("disaster", "n_disaster_state", "region", "year").distinct()
    return bars.withColumn("text_label", str_c("total disasters: ", num_label("n_disaster_state"),
                                               "\n", F.col("region")))


def region_year_totals(fact_a: DataFrame) -> DataFrame:
    """The corrected bar heights: one sum per region-year (D6 fixed)."""
    return (drop_any_null(fact_a).groupBy("region", "year")
            .agg(F.sum("n_disaster_state").alias("n_disasters")))


def map_long(fact_b: DataFrame) -> DataFrame:
    """The map app's long table ``state_code, year, variable_type, statistic``.

    Every column whose name starts with ``m`` (after the two renames) turns
    into rows; rows with any null are dropped; names are recoded to labels.
    One row per fact row and variable, so values repeat once per disaster
    type, as published.
    """
    wide = (fact_b.select("state_code", "year", "mean_temp", "max_temp", "min_temp",
                          "total_precip", "n_state")
            .withColumnsRenamed({"total_precip": "mtotal_precip", "n_state": "mn_state"}))
    value_cols = [c for c in wide.columns if c.startswith("m")]
    wide = wide.select("state_code", "year", *[F.col(c).cast("double").alias(c) for c in value_cols])
    long = drop_any_null(wide.unpivot(["state_code", "year"], value_cols, "variable_type", "statistic"))
    return long.replace(MAP_LABELS, subset=["variable_type"])


def map_slice(map_table: DataFrame, places: DataFrame, variable: str, year: int) -> DataFrame:
    """One variable in one year, one value per place, with hover text.

    The label is ``variable-name``, where an unknown code gives ``NA``.
    """
    names = places.select(F.col("state_code").alias("_code"), F.col("location").alias("_name"))
    rows = map_table.where((F.col("variable_type") == variable) & (F.col("year") == year))
    rows = rows.join(names, rows.state_code == names._code, "left")
    return rows.select("state_code", "year", "variable_type", "statistic",
                       paste(F.col("variable_type"), F.col("_name"), sep="-").alias("text_label"))


def place_type_trend(dash: DataFrame, state: str, disaster: str,
                     year_range: tuple[int, int]) -> DataFrame:
    """Count of one type in one place over a year range."""
    lo, hi = year_range
    return (dash.where((F.col("state") == state) & (F.col("disaster") == disaster)
                       & F.col("year").between(lo, hi))
            .select("state", "year", "disaster", "n_disaster_state"))


def count_vs_measure(dash: DataFrame, state: str, disaster: str,
                     year_range: tuple[int, int] | None = None) -> DataFrame:
    """Total count vs mean temperature for a place and type, with label (C11).

    The published panel ignores the year slider (defect D9); pass
    ``year_range`` to apply it.
    """
    cond = ((F.col("state") == state) & (F.col("disaster") == disaster)
            & F.col("n_state").isNotNull() & F.col("mean_temp").isNotNull())
    if year_range is not None:
        cond = cond & F.col("year").between(*year_range)
    label = str_c("Number of Disaster Events: ", num_label("n_state"),
                  "\nAverage Temperature: ", num_label(r_round("mean_temp", 1)), " F")
    return dash.where(cond).select("state", "year", "n_state", "mean_temp", label.alias("text_label"))


def _temp_label() -> F.Column:
    return str_c("Average Temperature: ", num_label(r_round("mean_temp", 1)), " F",
                 "\nMinimum Temperature: ", num_label(r_round("min_temp", 1)), " F",
                 "\nMaximum Temperature: ", num_label(r_round("max_temp", 1)), " F")


def measure_series(dash: DataFrame, state: str, year_range: tuple[int, int],
                   published: bool = True) -> DataFrame:
    """Yearly temperature series for one place, with label.

    Published: ``distinct`` over every fact column, so a year repeats once
    per disaster type.  Corrected: climate columns first, one row per year.
    """
    rows = dash.where((F.col("state") == state) & F.col("year").between(*year_range))
    if published:
        rows = rows.distinct()
    else:
        rows = rows.select("state", "year", "mean_temp", "min_temp", "max_temp").distinct()
    cols = ["state", "year", "mean_temp", "min_temp", "max_temp"] + (["disaster"] if published else [])
    return rows.select(*cols, _temp_label().alias("text_label"))


def option_lists(dash: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """Choices offered by the apps, as ``(list_name, value)`` rows.

    States and types come from the fact table without missing values; years
    are the years present.  Map variables are the labels of those measures
    that have a value for some place and year; the count of disasters has one
    where a declaration does, which is what the map's own table holds.
    ``years`` adds the ends of the slider's range, present in the data or not.
    """
    # One pass over the fact table for all lists: every row emits its tagged
    # values, missing ones are dropped, and one distinct (partial before the
    # shuffle) dedupes them all.
    def tagged(name: str, value: Column, where: Column) -> Column:
        return F.struct(F.lit(name).alias("list_name"), F.when(where, value).alias("value"))

    placed = F.col("state_code").isNotNull() & F.col("year").isNotNull()
    held = {"mean_temp": "mean_temp", "max_temp": "max_temp", "min_temp": "min_temp", "mtotal_precip": "total_precip",
            "mn_state": "disaster"}
    rows = F.explode(F.array(
        tagged("state", F.col("state"), not_na_text("state")),
        tagged("disaster", F.col("disaster"), not_na_text("disaster")),
        tagged("year", F.col("year").cast("string"), F.col("year").isNotNull()),
        *[tagged("variable_type", F.lit(MAP_LABELS[v]), placed & F.col(c).isNotNull()) for v, c in held.items()],
    )).alias("_o")
    out = dash.select(rows).select("_o.list_name", "_o.value").where(F.col("value").isNotNull()).distinct()
    if years is None:
        return out
    # On a table of one row, so that the range needs no Python data.
    ends = dash.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("list_name"), F.lit(str(y)).alias("value"))
        for n, y in zip(("year_from", "year_to"), years, strict=True)])).alias("_o")).select("_o.list_name", "_o.value")
    return out.unionByName(ends)
