"""Monthly climate series → state-year measures.

The reference writes each annual measure as a grouped ``mutate`` followed by
``distinct``; that is a group-by, and is planned here as one (partial
aggregate before the shuffle, final aggregate after).  The name → code
lookup runs after the aggregate, on one row per place-year instead of one
per raw record.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import NA_AGGS

# (output column, series name, summary) for the four published measures.
CLIMATE_MEASURES = (
    ("mean_temp", "tavg", "mean"),
    ("total_precip", "pcp", "sum"),
    ("max_temp", "tmax", "max"),
    ("min_temp", "tmin", "min"),
)


def with_year(raw: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Split ``yyyymm`` at position 4, convert the year, keep ``years``.

    ``try_cast`` turns bad text into null (as the reference's conversion
    does) and the range filter then drops it.  The month part is unused.
    """
    lo, hi = years
    year = F.expr("try_cast(substring(date, 1, 4) AS INT)")
    return raw.withColumn("year", year).where(F.col("year").between(lo, hi)).drop("date")


def attach_code(df: DataFrame, places: DataFrame) -> DataFrame:
    """Name → code lookup; a name not in the dictionary gets a null code."""
    codes = places.select("location", "state_code")
    return df.join(codes, on="location", how="left")


def annual_series(raw: DataFrame, places: DataFrame, measure: str, how: str,
                  years: tuple[int, int]) -> DataFrame:
    """One annual measure per place: ``state_code, location, year, <measure>``.

    ``how`` is one of mean/sum/max/min; one missing month makes the year's
    value missing.
    """
    agg = (with_year(raw, years)
           .groupBy("location", "year")
           .agg(NA_AGGS[how]("value").alias(measure)))
    return attach_code(agg, places).select("state_code", "location", "year", measure)


def climate_state_year(series: DataFrame | Mapping[str | tuple[str, ...], DataFrame], places: DataFrame,
                       years: tuple[int, int], measures=CLIMATE_MEASURES) -> DataFrame:
    """The four annual measures side by side, for place-years that have all four.

    The reference builds each series separately and chains three inner
    joins.  Here each source is reduced to place-years with its own measures
    (partial aggregate before the shuffle), and a second group-by over the
    union of these puts them side by side.  A place-year missing from any series is
    dropped, which is what the inner joins do.  A source of several series is
    listed under their names, which are its columns in place of ``value``; its
    rows are read once.  A single DataFrame means one source feeds every
    measure (no union).
    """
    if isinstance(series, DataFrame):
        staged = with_year(series, years)
        aggs = [NA_AGGS[how]("value").alias(out) for out, _, how in measures]
        grouped = staged.groupBy("location", "year").agg(*aggs)
    else:
        parts, outs = [], [out for out, _, _ in measures]
        for names, df in series.items():
            column = {names: "value"} if isinstance(names, str) else {name: name for name in names}
            own = [(out, column[name], how) for out, name, how in measures if name in column]
            part = with_year(df.select("location", "date", *column.values()), years)
            part = part.groupBy("location", "year").agg(*[NA_AGGS[how](c).alias(out) for out, c, how in own])
            parts.append(part.select("*", *[F.lit(1).alias(f"_n_{out}") for out, _, _ in own]))
        # One row per source and place-year: the greatest value is the only one.
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        grouped = both.groupBy("location", "year").agg(*[F.max(c).alias(c) for out in outs for c in (out, f"_n_{out}")])
        keep = reduce(lambda a, b: a & b, [F.col(f"_n_{out}").isNotNull() for out in outs])
        grouped = grouped.where(keep).drop(*[f"_n_{out}" for out in outs])
    cols = ["state_code", "location", "year"] + [out for out, _, _ in measures]
    return attach_code(grouped, places).select(*cols)
