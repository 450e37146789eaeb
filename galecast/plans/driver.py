"""The reference's pipeline wired onto the driver tables.

``DriverPipeline(spark, sf_dir)`` exposes every intermediate table of the
reference as a lazily built DataFrame.  Nothing is computed until an action
runs; each property builds its plan once per instance.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import climate as climate_ops
from ..operators import facts, hazards, rollups
from ..sources import tables
from . import products


class DriverPipeline:
    bounded = True  # places are a fixed list

    def __init__(self, spark: SparkSession, sf_dir: str, years: tuple[int, int] = tables.DRIVER_YEARS):
        self.spark = spark
        self.sf_dir = sf_dir
        self.years = years

    # sources ---------------------------------------------------------------
    @cached_property
    def places(self) -> DataFrame:
        return tables.nation_places(self.spark, self.sf_dir)

    @cached_property
    def climate_raw(self) -> DataFrame:
        return tables.climate_raw(self.spark, self.sf_dir, self.years)

    @cached_property
    def declarations_raw(self) -> DataFrame:
        return tables.declarations_raw(self.spark, self.sf_dir, self.years, weighted=True)

    # reductions ------------------------------------------------------------
    def annual(self, measure: str, how: str) -> DataFrame:
        return climate_ops.annual_series(self.climate_raw, self.places, measure, how, self.years)

    @cached_property
    def climate(self) -> DataFrame:
        return climate_ops.climate_state_year(self.climate_raw, self.places, self.years)

    @cached_property
    def counts(self) -> DataFrame:
        return hazards.declaration_counts(self.declarations_raw, self.years)

    @cached_property
    def totals(self) -> DataFrame:
        return hazards.declaration_totals(self.counts, self.bounded)

    # facts -----------------------------------------------------------------
    @cached_property
    def fact_a(self) -> DataFrame:
        return facts.fact_joined_then_counted(self.climate, self.counts, self.places, self.bounded)

    @cached_property
    def fact_b(self) -> DataFrame:
        return facts.fact_counted_then_joined(self.climate, self.totals)

    @cached_property
    def dash(self) -> DataFrame:
        return facts.dashboard_fact(self.fact_a)

    # rollups and products --------------------------------------------------
    @cached_property
    def regional(self) -> DataFrame:
        return rollups.regional_rollup(self.fact_a)

    @cached_property
    def regional_type(self) -> DataFrame:
        return rollups.regional_type_rollup(self.fact_a)

    @cached_property
    def map_table(self) -> DataFrame:
        return products.map_long(self.fact_b)

    @property
    def options(self) -> DataFrame:
        return products.option_lists(self.dash, self.years)


class CustomerPipeline(DriverPipeline):
    """The same tables with customers as places; four separate series meet in the climate table."""

    bounded = False

    @cached_property
    def places(self) -> DataFrame:
        return tables.customer_places(self.spark, self.sf_dir)

    @cached_property
    def climate(self) -> DataFrame:
        series = tables.customer_series(self.spark, self.sf_dir, self.years)
        return climate_ops.climate_state_year(series, self.places, self.years)

    @cached_property
    def declarations_raw(self) -> DataFrame:
        return tables.customer_declarations(self.spark, self.sf_dir, self.years)
