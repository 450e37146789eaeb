"""Registry of named queries over the driver tables.

Every entry takes ``(spark, sf_dir)`` and returns a DataFrame built from the
given tables, so its work grows with them.  Result doubles are rounded
half-up at 6 decimals (the reference's tables print 3): sums of 2-decimal
values sit far from any rounding boundary there, so a different summation
order cannot change the printed value, while at 4 decimals a mean such as
``x.xxxx5`` is a true tie that either order may round either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import rollups
from ..sources.sinks import round_doubles
from ..sources.tables import PANEL_TYPES
from . import models, products
from .driver import CustomerPipeline, DriverPipeline

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the interactive slices (the apps' inputs).
SLICE_VARIABLE = "Yearly Mean Temperature (degrees F)"
SLICE_YEAR = 1998
SLICE_STATE = "NATION_7"
SLICE_TYPE = "NF"
SLICE_WINDOW = (1996, 2000)

# Decimals of the published sums.  They grow with the data, and a double of
# ten digits and more does not hold six exact decimals; their terms have two.
SUMS = {"total_precip": 3, "sum_precip": 3}


def _q(build: Callable[[DriverPipeline], DataFrame], digits: int = 6, pipeline: type[DriverPipeline] = DriverPipeline,
       **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(build(pipeline(spark, sf_dir, **options)), digits, SUMS)
    return run


def relational_queries() -> dict[str, Query]:
    return {
        "annual_mean": _q(lambda p: p.annual("mean_temp", "mean")),
        "annual_sum": _q(lambda p: p.annual("total_precip", "sum")),
        "annual_max": _q(lambda p: p.annual("max_temp", "max")),
        "annual_min": _q(lambda p: p.annual("min_temp", "min")),
        "climate_state_year": _q(lambda p: p.climate),
        "declaration_counts": _q(lambda p: p.counts),
        "declaration_totals": _q(lambda p: p.totals),
        "fact_joined_then_counted": _q(lambda p: p.fact_a),
        "fact_counted_then_joined": _q(lambda p: p.fact_b),
        "regional_rollup": _q(lambda p: p.regional),
        "regional_rollup_dedup": _q(lambda p: rollups.regional_rollup(p.fact_a, dedupe=True)),
        "regional_type_rollup": _q(lambda p: p.regional_type),
        "type_by_region": _q(lambda p: rollups.type_by_region(p.fact_a)),
        "type_by_region_left_chain": _q(lambda p: rollups.type_by_region(p.fact_a, published=True)),
        "precip_points": _q(lambda p: products.precip_points(p.fact_a)),
        "precip_points_corrected": _q(lambda p: products.precip_points(p.fact_a, published=False)),
        "region_year_bars": _q(lambda p: products.region_year_bars(p.fact_a)),
        "region_year_totals": _q(lambda p: products.region_year_totals(p.fact_a)),
        "type_panel": _q(lambda p: products.type_panel(p.regional_type, PANEL_TYPES)),
        "map_long": _q(lambda p: p.map_table),
        "map_slice": _q(lambda p: products.map_slice(p.map_table, p.places, SLICE_VARIABLE, SLICE_YEAR)),
        "place_type_trend": _q(lambda p: products.place_type_trend(p.dash, SLICE_STATE, SLICE_TYPE, (1997, 2000))),
        "count_vs_measure": _q(lambda p: products.count_vs_measure(p.dash, SLICE_STATE, SLICE_TYPE)),
        "count_vs_measure_years": _q(lambda p: products.count_vs_measure(
            p.dash, SLICE_STATE, SLICE_TYPE, year_range=SLICE_WINDOW)),
        "measure_series_corrected": _q(lambda p: products.measure_series(p.dash, SLICE_STATE, (1996, 1999), published=False)),
        "measure_series": _q(lambda p: products.measure_series(p.dash, SLICE_STATE, (1996, 1999))),
        "regional_rollup_window": _q(lambda p: p.regional, years=SLICE_WINDOW),
        "climate_four_series": _q(lambda p: p.climate, pipeline=CustomerPipeline),
        "fact_by_customer": _q(lambda p: p.fact_a, pipeline=CustomerPipeline),
        "fact_by_customer_counted_first": _q(lambda p: p.fact_b, pipeline=CustomerPipeline),
        "option_lists": _q(lambda p: p.options),
    }


def model_queries() -> dict[str, Query]:
    """Fits, cross-validation, densities and trends.

    Models on the regional table follow the reference's formula; models on
    the order table scale with the data.  The ``*_by_group`` fits and the
    densities have closed-form / SQL statements; the others are checked by
    row count here and by score equations in the tests.
    """
    reg, odr = models.REGIONAL_FORMULA, models.ORDER_FORMULA
    return {
        "poisson_regional": _q(lambda p: models.tidy(p.regional, reg, "poisson"), 6),
        "negbin_regional": _q(lambda p: models.tidy(p.regional, reg, "negbin"), 6),
        "model_aic_regional": _q(lambda p: models.glance(p.regional, reg), 3),
        "model_choice": _q(lambda p: models.model_choice(p.regional, reg), 3),
        "unit_effect": _q(lambda p: models.unit_effect(p.regional, reg), 3),
        "poisson_orders": _q(lambda p: models.tidy(models.order_rows(p), odr, "poisson"), 6),
        "negbin_orders": _q(lambda p: models.tidy(models.order_rows(p), odr, "negbin"), 6),
        "model_aic_orders": _q(lambda p: models.glance(models.order_rows(p), odr), 3),
        "poisson_by_group": _q(lambda p: models.by_group(models.order_rows(p), "y", "region", "poisson")
                               .select("term", "estimate", "std_error", "exp_estimate"), 6),
        "negbin_by_group": _q(lambda p: models.by_group(models.order_rows(p), "y", "region", "negbin")
                              .select("term", "estimate", "exp_estimate"), 6),
        "cv_splits": _q(lambda p: models.cv_splits(p.regional, ["region", "year"])),
        "cv_splits_orders": _q(lambda p: models.cv_splits(models.order_rows(p), ["order_key"])),
        "cv_errors": _q(lambda p: models.cv_errors(p.regional, reg), 6),
        "cv_errors_published": _q(lambda p: models.cv_errors(p.regional, reg, leaky=True, scale="link"), 6),
        "density": _q(lambda p: models.count_density(p.regional), 6),
        "cv_error_density": _q(lambda p: models.cv_error_density(p.regional, reg), 6),
        "density_by_group": _q(lambda p: models.density_by(models.order_rows(p), "y", ["region"]), 6),
        "poisson_regional_scores": _q(lambda p: models.scores(p.regional, reg, "poisson"), 5),
        "negbin_regional_scores": _q(lambda p: models.scores(p.regional, reg, "negbin"), 5),
        "poisson_orders_scores": _q(lambda p: models.scores(models.order_rows(p), odr, "poisson"), 5),
        "negbin_orders_scores": _q(lambda p: models.scores(models.order_rows(p), odr, "negbin"), 5),
        "aic_by_group": _q(lambda p: models.aic_by_group(models.order_rows(p), "y", "region"), 3),
        "cv_errors_orders": _q(lambda p: models.cv_errors_hashed(
            models.order_rows(p), odr, ["order_key"]), 6),
        "poisson_aliased": _q(lambda p: models.tidy_aliased(models.order_rows(p)), 6),
        "poisson_interaction": _q(lambda p: models.tidy_interaction(models.order_rows(p)), 6),
        "priority_levels": _q(models.priority_levels),
        "order_kinds": _q(models.order_kinds),
        "density_totalprice": _q(models.price_density, 6),
        "trend_points": _q(lambda p: models.temp_points(p.fact_a)),
        "trend_loess": _q(lambda p: models.temp_trend(p.fact_a, "loess"), 4),
        "trend_smooth": _q(lambda p: models.temp_trend(p.fact_a), 4),
        "trend_smooth_scores": _q(lambda p: models.smooth_scores(p.fact_a), 4),
        "trend_loess_price": _q(models.price_trend, 4),
    }


def all_queries() -> dict[str, Query]:
    return {**relational_queries(), **model_queries()}
