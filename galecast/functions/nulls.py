"""Aggregates and predicates with the reference's missing-value rules.

The reference summarises with ``mean/sum/max/min`` without ``na.rm``: one
missing value in a group makes the whole result missing.  Spark's built-in
aggregates skip nulls, so every published-form aggregate goes through these
wrappers.  They stay plain Catalyst expressions (partial + final hash
aggregate, whole-stage codegen); nothing here runs in Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _null_if_any_missing(agg: Column, c: Column, present: Column | None = None) -> Column:
    # count(*) vs count(x): equal only when no row of the group holds null.
    total = F.count(F.lit(1)) if present is None else F.count(present)
    return F.when(total == F.count(c), agg)


def na_mean(c: str | Column, present: Column | None = None) -> Column:
    """``mean(x)`` that is null when any value of the group is null."""
    c = _col(c)
    return _null_if_any_missing(F.avg(c), c, present)


def na_sum(c: str | Column, present: Column | None = None) -> Column:
    """``sum(x)`` that is null when any value of the group is null."""
    c = _col(c)
    return _null_if_any_missing(F.sum(c), c, present)


def na_max(c: str | Column, present: Column | None = None) -> Column:
    c = _col(c)
    return _null_if_any_missing(F.max(c), c, present)


def na_min(c: str | Column, present: Column | None = None) -> Column:
    c = _col(c)
    return _null_if_any_missing(F.min(c), c, present)


NA_AGGS = {"mean": na_mean, "sum": na_sum, "max": na_max, "min": na_min}


def not_na_text(c: str | Column) -> Column:
    """``x != "NA"`` on a text column: drops nulls and the literal text."""
    c = _col(c)
    return c.isNotNull() & (c != F.lit("NA"))


def null_safe_on(left: DataFrame, right: DataFrame,
                 pairs: Sequence[tuple[str, str]]) -> Column:
    """Join condition where null matches null, as in the reference's joins."""
    return reduce(lambda a, b: a & b,
                  [left[lc].eqNullSafe(right[rc]) for lc, rc in pairs])


def drop_any_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """``drop_na()``: drop a row when any of the columns is null."""
    return df.dropna(how="any", subset=list(subset) if subset else None)
