"""Joining a large table to a small one, one row per group, when a group may hold most of the large one.

A plain equi-join on the group key would send a hot group to one task whenever
the planner does not broadcast the small side; and size estimates of grouped
aggregates do not shrink with the grouping, so it often does not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SALTS = 64


def attach_groups(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str],
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``big`` joined to ``small`` on ``keys``, nulls matching nulls.

    ``small`` (staged, a few numbers per group) is counted: up to
    ``broadcast_rows`` rows it is broadcast.  Beyond, the groups are salted by
    a hash of the ``spread`` columns, so that a hot one goes to SALTS tasks.
    """
    renamed = small.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in small.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    drop = [f"_k_{k}" for k in keys]
    if small.count() <= broadcast_rows:
        return big.join(F.broadcast(renamed), reduce(and_, on)).drop(*drop)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    copies = renamed.withColumn("_k__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, reduce(and_, [*on, F.col("_salt") == F.col("_k__salt")])).drop(*drop, "_salt", "_k__salt")
