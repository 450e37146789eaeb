"""Levels of a column in the order in which they first appear.

An ordered level table holds each level once with its number.  "First" is the
least of an order that the caller states: columns of the table, or the place of a row in
the files it was read from (``read_order``).  One aggregate finds it, whatever
the number of rows; only the level table is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import attach_groups
from ..session import stage_table


def read_order(df: DataFrame, name: str = "read_at") -> DataFrame:
    """``df``, a scan of files, with each row's file, block and place in the block as a column to order by."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                   F.monotonically_increasing_id().alias("row")).alias(name))


def first_appearance(df: DataFrame, column: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """``column, position``: the levels of a column numbered from 1 by the least ``order`` of their rows; null is no level."""
    first = (df.where(F.col(column).isNotNull()).groupBy(column)
             .agg(F.min(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])).alias("_first")))
    # One row per level.
    return first.select(column, F.row_number().over(Window.orderBy("_first", column)).alias(name))


def with_first_order(df: DataFrame, column: str, name: str, order: Sequence[str]) -> DataFrame:
    """``df`` with the number of its row's level."""
    levels = stage_table(first_appearance(df, column, order, name), "levels", small=True)
    rest = [c for c in df.columns if c != column]
    return attach_groups(df, levels, [column], rest)
