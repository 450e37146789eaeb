"""Kernel density on a grid, per group.

Gaussian kernel, bandwidth by the normal reference rule the reference's
plots use (``0.9 · min(sd, IQR/1.34) · n^-0.2``), evaluated at ``n`` grid
points spanning each group's range.

The data are first reduced to their distinct values with counts; that
table is written once under the checkpoint folder (every step below reads
it) and feeds the exact quartiles of the IQR (``quantile.exact_quantiles``,
which never holds a group in one task).  The values are then linearly
binned onto the grid: every value splits its weight between the two
nearest grid points.
Only the binned masses — at most ``n`` rows per group, whatever the data
size — meet the grid, through an ``explode`` of grid indices; the result is
``sum(mass · φ((x − g) / bw)) / bw``.  No row of the data is ever paired
with another.  Densities integrate to about 1 over the data range plus the
tails.  A missing group key is a group like any other; missing values are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import attach_groups
from ..session import stage_table
from .quantile import exact_quantiles

INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)


def bandwidth_nrd0(sd, iqr, n, first_abs) -> F.Column:
    """R's default rule with its fall-backs for degenerate spreads."""
    lo = F.least(sd, iqr / F.lit(1.34))
    lo = (F.when(lo > 0, lo).when(sd > 0, sd)
          .when(first_abs > 0, first_abs).otherwise(F.lit(1.0)))
    return F.lit(0.9) * lo * F.pow(n.cast("double"), F.lit(-0.2))


def density(df: DataFrame, col: str, by: Sequence[str] = (), n: int = 512) -> DataFrame:
    """``by..., x, density`` on ``n`` points from the group's min to max."""
    keyless = not by
    by = list(by) or ["_all"]
    if keyless:
        df = df.withColumn("_all", F.lit(0))
    values = df.select(*by, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    freq = stage_table(values.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")), "density-values")
    stats = stage_table(freq.groupBy(*by).agg(
        F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min(F.abs("_v")).alias("_first_abs"),
    ), "density-stats", small=True)
    quartiles = exact_quantiles(freq, by, [0.25, 0.75], stats=stats)
    # Squares around the least value: its own gap to the mean is in the sum, so the difference
    # of the two sums below keeps all but a factor n of a double's precision.
    gap = F.col("_v") - F.col("_lo")
    squares = attach_groups(freq, stats, by, ["_v"]).groupBy(*by).agg(
        F.first("_n").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_first_abs").alias("_first_abs"),
        F.sum(gap * gap * F.col("_c")).alias("_s2"), F.sum(gap * F.col("_c")).alias("_s1"))
    squares = squares.withColumn("_ss", F.greatest(F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_n"), F.lit(0.0)))
    keys = [F.col(c).alias(f"_k_{c}") for c in by]
    quartiles = quartiles.select(*keys, F.col("q0").alias("_q1"), F.col("q1").alias("_q3"))
    stats = squares.join(quartiles, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]))  # one row a group on either side
    sd = F.when(F.col("_n") > 1, F.sqrt(F.col("_ss") / (F.col("_n") - F.lit(1)))).otherwise(F.lit(0.0))
    stats = stage_table(stats.select(
        *by, "_n", "_lo",
        F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / F.lit(n - 1))
         .otherwise(F.lit(0.0)).alias("_delta"),
        bandwidth_nrd0(sd, F.col("_q3") - F.col("_q1"), F.col("_n"), F.col("_first_abs")).alias("_bw"),
    ), "density-groups", small=True)
    # Linear binning onto the grid.
    pos = F.when(F.col("_delta") > 0, (F.col("_v") - F.col("_lo")) / F.col("_delta")).otherwise(F.lit(0.0))
    binned = attach_groups(freq, stats, by, ["_v"])
    binned = binned.withColumn("_pos", pos).withColumn("_ix", F.floor("_pos"))
    share = F.col("_c") / F.col("_n")
    frac = F.col("_pos") - F.col("_ix")
    parts = F.explode(F.array(
        F.struct(F.col("_ix").alias("j"), (share * (F.lit(1.0) - frac)).alias("m")),
        F.struct((F.col("_ix") + 1).alias("j"), (share * frac).alias("m")),
    )).alias("_part")
    bins = (binned.select(*by, parts)
            .where(F.col("_part.m") > 0)
            # Rounding may put the greatest value past the last grid point.
            .groupBy(*by, F.least(F.col("_part.j"), F.lit(n - 1)).alias("j")).agg(F.sum(F.col("_part.m")).alias("mass")))
    grid = attach_groups(bins, stats, by, ["j"])
    grid = grid.select(*by, "j", "mass", "_lo", "_delta", "_bw",
                       F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("u"))
    gap = ((F.col("u") - F.col("j")) * F.col("_delta")) / F.col("_bw")
    kern = F.col("mass") * F.exp(F.lit(-0.5) * gap * gap) * F.lit(INV_SQRT_2PI) / F.col("_bw")
    out = grid.groupBy(*by, "u", "_lo", "_delta").agg(F.sum(kern).alias("density"))
    out = out.select(*by, (F.col("_lo") + F.col("u") * F.col("_delta")).alias("x"), "density")
    return out.drop("_all") if keyless else out
