"""Declaration records → counts at several grains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import attach_groups
from ..session import stage_table


def declaration_counts(decl: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Rows per ``(state, year, disaster)``; only groups that occur.

    ``fy_declared`` is renamed ``year`` and ``incident_type`` becomes the
    category ``disaster``.  The count is a partial + final aggregate, so a
    state holding a third of all records still leaves the map side as one
    row per group and partition.
    """
    lo, hi = years
    year = F.expr("try_cast(fy_declared AS INT)")
    # Records may come pre-counted (``n_records``, see tables.declarations_raw).
    weight = F.col("n_records").cast("long") if "n_records" in decl.columns else F.lit(1).cast("long")
    return (decl.select(F.col("state"), year.alias("year"), F.col("incident_type").alias("disaster"),
                        weight.alias("_w"))
            .where(F.col("year").between(lo, hi))
            .groupBy("state", "year", "disaster")
            .agg(F.sum("_w").alias("n")))


def grouped_totals(df: DataFrame, sets: list[list[str]], keys: list[str], count: str) -> DataFrame:
    """``keys..., grouping, total`` of every grouping set: one expand, one aggregate.  A key outside a row's set is null;
    ``grouping`` tells that from a null of the data."""
    grouped = df.groupingSets([[F.col(k) for k in kept] for kept in sets], *[F.col(k) for k in keys])
    return grouped.agg(F.grouping_id().cast("int").alias("grouping"), F.sum(count).alias("total")).select(*keys, "grouping", "total")


def grouping(keys: list[str], kept: list[str]) -> int:
    """The ``grouping`` number of the set that keeps these of the keys: a bit for each key, set where it is left out."""
    return sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in kept)


def with_totals(df: DataFrame, place: str, count: str = "n", bounded: bool = True) -> DataFrame:
    """Attach ``n_state`` (per year and place), ``n_total`` (per year) and
    ``n_type`` (per year and type), then rename ``count`` to
    ``n_disaster_state``.

    ``bounded`` says that the places are a fixed list, so that the table is
    bounded by places × years × types however large the raw data are.  The
    three windows then all start with ``year``: after the first exchange (hash
    on ``year``) the other two need only a sort.

    Where places grow with the data, a year's rows must not meet in one task:
    grouping sets give all three totals in one aggregate (partial sums, one exchange), and
    are attached to the staged table, nulls matching nulls: the totals of years and of year-types by
    a size-checked broadcast or salted, those of places by a join that adaptive execution can split.
    """
    if bounded:
        by_year = Window.partitionBy("year")
        by_place = Window.partitionBy("year", place)
        by_type = Window.partitionBy("year", "disaster")
        out = (df.withColumn("n_total", F.sum(count).over(by_year))
               .withColumn("n_state", F.sum(count).over(by_place))
               .withColumn("n_type", F.sum(count).over(by_type)))
    else:
        out = df = stage_table(df, "counts")
        keys = ["year", place, "disaster"]
        totals = stage_table(grouped_totals(df, [["year"], ["year", place], ["year", "disaster"]], keys, count), "totals")

        def of(kept: list[str], name: str) -> DataFrame:
            return totals.where(F.col("grouping") == grouping(keys, kept)).select(*kept, F.col("total").alias(name))

        out = attach_groups(out, of(["year"], "n_total"), ["year"], [place, "disaster"])
        out = attach_groups(out, of(["year", "disaster"], "n_type"), ["year", "disaster"], [place])
        by_place = of(["year", place], "n_state").withColumnRenamed("year", "_year").withColumnRenamed(place, "_place")
        out = out.join(by_place, F.col("year").eqNullSafe(F.col("_year")) & F.col(place).eqNullSafe(F.col("_place"))).drop("_year", "_place")
    return out.withColumnRenamed(count, "n_disaster_state")


def declaration_totals(counts: DataFrame, bounded: bool = True) -> DataFrame:
    """Counts with their totals, computed before any join (variant B, C2).

    Territories keep their own ``n_state`` because the place key is the
    declaration's own ``state``.
    """
    return with_totals(counts, "state", bounded=bounded).select(
        "state", "year", "disaster", "n_disaster_state", "n_state", "n_total", "n_type")
