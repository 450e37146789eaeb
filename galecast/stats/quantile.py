"""Exact quantiles per group without holding a group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, so a group holding a third of a continuous column would
land whole in one task.  Here an order statistic is found by refinement:

* every target is ``(group, target id, rank)`` with the search interval
  ``[a, b]`` of values still holding it and the rank within that interval;
* one pass joins the value table to the open targets, cuts each interval
  into ``bins`` equal-width buckets and aggregates ``count / min / max`` per
  bucket (partial aggregation first, so a hot group is summed map-side);
* a window over at most ``bins`` rows per target picks the bucket holding
  the rank; the interval shrinks to that bucket's actual ``[min, max]``.

A target is resolved when its interval holds a single value.  Integer-like
data resolve in one pass; each further pass divides the spread of the
remaining values by ``bins``.  The target table (groups × targets rows) is
the only state; each pass writes it as a small table in the checkpoint
folder, which also cuts its lineage.

Quantiles use the definition of R's and DuckDB's default (type 7):
``h = (n − 1)·p``, ``x[⌊h⌋] + (h − ⌊h⌋)(x[⌊h⌋+1] − x[⌊h⌋])``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import attach_groups
from ..session import drop_staged, stage_table


def _refine(freq: DataFrame, targets: DataFrame, by: list[str], bins: int) -> DataFrame:
    """One pass: shrink every open target's interval to one bucket."""
    open_t = targets.where(~F.col("_done"))
    span = F.col("_b") - F.col("_a")
    bucket = F.least(F.floor((F.col("_v") - F.col("_a")) / span * F.lit(bins)).cast("int"),
                     F.lit(bins - 1))
    hist = (attach_groups(freq, open_t, by, ["_v"])
            .where(F.col("_v").between(F.col("_a"), F.col("_b")))
            .groupBy(*by, "_t", "_w", "_r", bucket.alias("_k"))
            .agg(F.sum("_c").alias("_kc"), F.min("_v").alias("_kmin"), F.max("_v").alias("_kmax")))
    w = Window.partitionBy(*by, "_t").orderBy("_k")
    hist = hist.withColumn("_cum", F.sum("_kc").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = hist.where((F.col("_cum") - F.col("_kc") <= F.col("_r")) & (F.col("_r") < F.col("_cum")))
    moved = hit.select(*by, "_t", "_w",
                       (F.col("_r") - (F.col("_cum") - F.col("_kc"))).alias("_r"),
                       F.col("_kmin").alias("_a"), F.col("_kmax").alias("_b"),
                       (F.col("_kmin") == F.col("_kmax")).alias("_done"))
    return targets.where(F.col("_done")).unionByName(moved)


def settled(freq: DataFrame, targets: DataFrame, by: list[str], bins: int = 4096, max_passes: int = 64) -> DataFrame:
    """The targets ``by..., _t, _w, _r, _a, _b, _done`` refined until ``_a = _b`` is the value of rank ``_r`` within ``_a.._b``.

    ``freq`` has ``by..., _v, _c``; ``_w`` is carried along.
    """
    for _ in range(max_passes):
        before, targets = targets, stage_table(_refine(freq, targets, by, bins), "quantile-targets", small=True)
        drop_staged(before)
        if targets.where(~F.col("_done")).isEmpty():
            return targets
    raise RuntimeError("quantiles: refinement did not settle")


def exact_quantiles(freq: DataFrame, by: Sequence[str], probs: Sequence[float],
                    value: str = "_v", count: str = "_c", bins: int = 4096,
                    max_passes: int = 64, stats: DataFrame | None = None) -> DataFrame:
    """``by..., q0, q1, ...`` (type-7 quantiles at ``probs``) per group.

    ``freq`` has one row per group and value with its count (a plain table
    is the case ``count`` = 1 per row); null values must be removed first.
    ``stats`` has ``by..., _n, _lo, _hi`` per group where the caller knows them.
    """
    by = list(by)
    freq = freq.select(*by, F.col(value).cast("double").alias("_v"), F.col(count).cast("long").alias("_c"))
    if stats is None:
        stats = stage_table(freq.groupBy(*by).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")),
                            "quantile-groups", small=True)
    # Two order statistics per probability, ranks floor(h) and floor(h) + 1, and the weight of each.
    parts = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - F.lit(1)).cast("double") * F.lit(float(p))
        rank = F.floor(h).cast("long")
        frac = h - F.floor(h)
        parts += [F.struct(F.lit(2 * i).alias("_t"), (F.lit(1.0) - frac).alias("_w"), rank.alias("_r")),
                  F.struct(F.lit(2 * i + 1).alias("_t"), frac.alias("_w"), F.least(rank + F.lit(1), F.col("_n") - F.lit(1)).alias("_r"))]
    targets = stats.select(*by, F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), (F.col("_lo") == F.col("_hi")).alias("_done"),
                           F.explode(F.array(*parts)).alias("_p")).select(*by, "_p.*", "_a", "_b", "_done")
    targets = settled(freq, targets, by, bins, max_passes)
    return targets.groupBy(*by).agg(*[F.sum(F.when(F.floor(F.col("_t") / 2) == i, F.col("_w") * F.col("_a"))).alias(f"q{i}")
                                      for i in range(len(probs))])
