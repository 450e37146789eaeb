"""Sinks: chart-ready tables, small result tables and single values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_doubles(df: DataFrame, digits: int = 3, columns: Mapping[str, int] | None = None) -> DataFrame:
    """Round every double column half-up at ``digits`` decimals, or as ``columns`` says for its name.

    This is ``floor(x * 10^d + 0.5) / 10^d`` with the floor taken in doubles
    (``v - pmod(v, 1)``): Spark's ``floor`` gives a long, which would clamp
    large values.  Any engine doing the same IEEE arithmetic gives the same
    bits.  NaN stays NaN, and infinities and values whose scaled form
    overflows are passed through.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            scale = float(10 ** (columns or {}).get(f.name, digits))
            x = F.col(f.name).cast("double")
            v = x * scale + 0.5
            cols.append(F.when(F.abs(v) < float("inf"), (v - F.pmod(v, F.lit(1.0))) / scale).otherwise(x).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Publish a chart-ready table as Parquet, optionally partitioned.

    Partitioning by the column a reader filters on (``variable_type`` for the
    map table, for example) lets later slices prune whole directories.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def pull(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of one column, as a one-column DataFrame."""
    return df.select(column).distinct()


def scalar(df: DataFrame, column: str):
    """One value out of a result that is already reduced to one row."""
    row = df.select(column).first()
    return None if row is None else row[0]
