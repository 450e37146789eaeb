"""The statistical page as queries: model tables, fits, CV, densities, trends.

Two model tables are used:

* ``regional``: the reference's own model table, ``count_region ~ year +
  region + ave_temp + sum_precip`` (region-year rows, bounded by
  regions × years);
* ``orders``: one row per order, ``y`` = total line quantity, on year,
  customer region and total price.  Its size follows the data, which is
  what exercises the distributed fitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import guess
from ..sources.tables import order_model_rows, table
from ..stats import cv, glm, kde, smooth
from ..functions.nulls import drop_any_null
from ..operators import levels
from .driver import DriverPipeline

REGIONAL_FORMULA = "count_region ~ year + region + ave_temp + sum_precip"
ORDER_FORMULA = "y ~ year + region + totalprice"
CV_SPLITS = 100
CV_SEED = 20191206


def order_rows(p: DriverPipeline) -> DataFrame:
    if not hasattr(p, "_order_rows"):
        p._order_rows = order_model_rows(p.spark, p.sf_dir)
    return p._order_rows


def fit(df: DataFrame, formula, family: str) -> glm.Fit:
    return glm.glm(df, formula, family)


def tidy(df: DataFrame, formula, family: str) -> DataFrame:
    return glm.tidy(df.sparkSession, fit(df, formula, family))


def glance(df: DataFrame, formula) -> DataFrame:
    both = fit(df, formula, "both")
    fits = {"poisson": both["poisson"], "negative_binomial": both["negbin"]}
    return glm.glance(df.sparkSession, fits)


def model_choice(df: DataFrame, formula) -> DataFrame:
    """The model with the lowest AIC (the rule the reference states, D4 fixed)."""
    g = glance(df, formula)
    return g.orderBy(F.asc("aic"), F.asc("model")).limit(1).select("model", "aic")


def unit_effect(df: DataFrame, formula, term: str = "year", digits: int = 3) -> DataFrame:
    """``exp(estimate)`` of one term rounded like the reference's inline number."""
    t = tidy(df, formula, "poisson")
    return t.where(F.col("term") == term).select(
        "term", F.bround("exp_estimate", digits).alias("rate_ratio"))


def by_group(df: DataFrame, response: str, factor: str, family: str) -> DataFrame:
    """Model with one categorical regressor (closed-form checkable)."""
    return glm.tidy(df.sparkSession, glm.glm(df, f"{response} ~ {factor}", family))


def cv_errors(df: DataFrame, formula, leaky: bool = False, scale: str = "response") -> DataFrame:
    return cv.cv_errors(df, formula, key_cols=["region", "year"],
                        n_splits=CV_SPLITS, seed=CV_SEED, leaky=leaky, scale=scale, exact=True)


def cv_splits(df: DataFrame, key_cols: list[str]) -> DataFrame:
    return cv.split_sizes(df, key_cols, CV_SPLITS, seed=CV_SEED, exact=True)


def count_density(regional: DataFrame) -> DataFrame:
    """Density of the regional counts after the reference's ``distinct``."""
    return kde.density(regional.select("year", "count_region").distinct(), "count_region")


def cv_error_density(df: DataFrame, formula) -> DataFrame:
    """Test-error distribution per model, as the reference's violin plot."""
    errs = cv_errors(df, formula, leaky=True, scale="link")
    return kde.density(errs, "rmse", by=["model"])


def density_by(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    return kde.density(df, col, by=by)


def temp_trend(fact_a: DataFrame, method: str = "spline") -> DataFrame:
    """Smoothed mean temperature by region over the years (C5), by a penalised spline or locally (``loess``)."""
    pts = drop_any_null(fact_a).select("region", "year", "mean_temp")
    smoother = {"spline": smooth.trend_smooth, "loess": smooth.trend_loess}[method]
    return smoother(pts, "year", "mean_temp", ["region"])


def price_trend(p: DriverPipeline) -> DataFrame:
    """Quantity of an order along its price, a continuous x, by region."""
    rows = order_rows(p).select("region", "y", (F.col("totalprice") / 1000).alias("price"))
    return smooth.trend_loess_dense(rows, "price", "y", ["region"])


def smooth_scores(fact_a: DataFrame) -> DataFrame:
    """The derivative of each spline's REML criterion at its weight, or its part that leads back into the weights' range: zero."""
    pts = drop_any_null(fact_a).select("region", "year", "mean_temp")
    return smooth.spline_fits(pts, "year", "mean_temp", ["region"]).select("region", F.abs("score").alias("score"))


def temp_points(fact_a: DataFrame) -> DataFrame:
    """The points behind the trend."""
    return drop_any_null(fact_a).select("region", "year", "mean_temp").distinct()


def scores(df: DataFrame, formula, family: str) -> DataFrame:
    """What is left of the likelihood's derivative at the fit: zero for every term."""
    return glm.score_check(df, formula, family)


def aic_by_group(df: DataFrame, response: str, factor: str) -> DataFrame:
    """AIC of the Poisson model with one categorical regressor (closed-form checkable)."""
    f = glm.glm(df, f"{response} ~ {factor}", "poisson")
    return glm.glance(df.sparkSession, {"poisson": f}).select("model", "n", "loglik", "aic")


def cv_errors_hashed(df: DataFrame, formula, key_cols: list[str]) -> DataFrame:
    """Cross-validation on a table that grows: split membership by hash."""
    return cv.cv_errors(df, formula, key_cols=key_cols, n_splits=CV_SPLITS, seed=CV_SEED)


def tidy_aliased(df: DataFrame) -> DataFrame:
    """A one-factor model and a column that the factor decides: its coefficient is null, the others are as without it."""
    both = df.withColumn("region_size", F.length("region").cast("double"))
    f = glm.glm(both, "y ~ region + region_size")
    return glm.tidy(df.sparkSession, f).select("term", "estimate", "std_error", F.lit(f.rank).alias("rank"))


def tidy_interaction(df: DataFrame) -> DataFrame:
    """Factor by factor with all products: the fitted cells are the cells' means."""
    cells = df.withColumn("size", F.when(F.col("totalprice") > 150000, F.lit("large")).otherwise(F.lit("small")))
    f = glm.glm(cells, "y ~ region * size")
    return glm.tidy(df.sparkSession, f).select("term", "estimate", "exp_estimate")


def order_kinds(p: DriverPipeline) -> DataFrame:
    """The kinds that the order table's columns have as text."""
    text = table(p.spark, p.sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_key"), F.col("o_totalprice").cast("string").alias("total_price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"),
        F.when(F.col("o_orderstatus") == "F", "T").when(F.col("o_orderstatus") == "O", "F").alias("finished"), "o_orderpriority")
    return guess.guess_kinds(text)


def priority_levels(p: DriverPipeline) -> DataFrame:
    """Order priorities as they first appear by order date and key."""
    orders = table(p.spark, p.sf_dir, "orders")
    return levels.first_appearance(orders, "o_orderpriority", ["o_orderdate", "o_orderkey"])


def price_density(p: DriverPipeline) -> DataFrame:
    """Density of a continuous column with about as many values as rows."""
    orders = table(p.spark, p.sf_dir, "orders")
    return kde.density(orders.select((F.col("o_totalprice") / 1000).alias("v")), "v")
