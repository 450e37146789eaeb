"""Guessed column types and the cells that don't fit.

A column's kind is the narrowest that all its cells fit, in the lattice

    logical, date, integer < double   all below text

found by one aggregate over all columns of all files: for each column and kind,
whether every cell that isn't missing fits.  Partial results are a few
booleans a task, so the guess sees every row, not a first thousand.  A column
without cells is logical.

``read_csv`` reads with guessed or stated kinds.  Cells that don't fit a stated
kind become null and are listed, as are lines with too few or too many columns,
with file and row: a task sums up each block of a file in one row (its number
of rows and its misfits), and a running sum over the blocks of a file
gives the first row number of each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_names
from ..session import stage_table

KINDS = ("logical", "integer", "double", "date", "text")
MISSING = ("", "NA")
_SPARK = {"logical": "boolean", "integer": "bigint", "double": "double", "date": "date", "text": "string"}
_SHAPE = {"logical": r"^(T|F|TRUE|FALSE|True|False|true|false)$", "integer": r"^[+-]?[0-9]+$",
          "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}
_BAD_LINE = "bad_line"


def _cell(name: str) -> Column:
    """A cell without spaces around it, null if missing."""
    text = F.trim(F.col(f"`{name}`").cast("string"))
    return F.when(~text.isin(*MISSING), text)


def converted(cell: Column, kind: str) -> Column:
    """The cell as a value of its kind, null if it doesn't fit."""
    if kind == "text":
        return cell
    return F.when(cell.rlike(_SHAPE[kind]), cell.try_cast(_SPARK[kind]))


def guess_kinds(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, kind, cells, missing``: one row for each text column of ``df``, by one pass."""
    columns = list(df.columns if columns is None else columns)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        cell = _cell(c)
        aggs.append(F.count(cell).alias(f"n{i}"))
        aggs += [F.min(F.when(cell.isNotNull(), converted(cell, k).isNotNull())).alias(f"{k}{i}") for k in KINDS[:-1]]
    found = df.agg(*aggs)
    each = []
    for i, c in enumerate(columns):
        kind = F.lit("text")
        for k in reversed(KINDS[:-1]):
            kind = F.when(F.coalesce(F.col(f"{k}{i}"), F.lit(True)), F.lit(k)).otherwise(kind)
        each.append(F.struct(F.lit(c).alias("column"), kind.alias("kind"), F.col(f"n{i}").alias("cells"),
                             (F.col("rows") - F.col(f"n{i}")).alias("missing")))
    return found.select(F.explode(F.array(*each)).alias("e")).select("e.*")


def _text_columns(spark: SparkSession, path: str | Sequence[str], options: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """The files' cells as text under their cleaned names, and ``bad_line`` where a line has too few or too many."""
    paths = [path] if isinstance(path, str) else list(path)
    base = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", **options}
    names = spark.read.options(**base).option("inferSchema", "false").csv(paths).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BAD_LINE]])
    raw = spark.read.options(**base).option("columnNameOfCorruptRecord", _BAD_LINE).schema(schema).csv(paths)
    cleaned = clean_names(names)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                  F.monotonically_increasing_id().alias("id")).alias("at")
    return raw.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, cleaned, strict=True)], _BAD_LINE, at), cleaned


def _problems(raw: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """``file, row, column, expected, actual`` of every cell that isn't of its kind and every line of another width."""
    def told(column: Column, expected: str, actual: Column) -> Column:
        return F.struct(F.col("at.id").alias("id"), column.cast("string").alias("column"), F.lit(expected).alias("expected"), actual.alias("actual"))

    checks = [F.when(F.col(_BAD_LINE).isNotNull(), told(F.lit(None), f"{len(kinds)} columns", F.col(_BAD_LINE)))]
    for name, kind in kinds.items():
        if kind != "text":
            cell = _cell(name)
            checks.append(F.when(cell.isNotNull() & converted(cell, kind).isNull(), told(F.lit(name), kind, cell)))
    found = raw.select("at", F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("found"))
    # A block is one task's share of a file; its rows follow each other.
    blocks = found.groupBy("at.file", "at.block").agg(
        F.count(F.lit(1)).alias("rows"), F.min("at.id").alias("first"),
        F.flatten(F.collect_list(F.when(F.size("found") > 0, F.col("found")))).alias("found"))
    blocks = stage_table(blocks, "csv-problems", small=True)
    before = F.sum("rows").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    each = blocks.select("file", "first", F.coalesce(before, F.lit(0)).alias("before"), "found").select(
        "file", "first", "before", F.explode("found").alias("p"))
    return each.select("file", (F.col("before") + F.col("p.id") - F.col("first") + 1).alias("row"), "p.column", "p.expected", "p.actual")


def read_csv(spark: SparkSession, path: str | Sequence[str], kinds: Mapping[str, str] | None = None,
             **options: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, problems)`` of files with a header of the same columns.

    Names are cleaned to snake_case.  A column's kind is the stated one, or else the one that all its cells fit.
    ``problems`` lists what was read as null: ``file, row`` (of the data, from 1), ``column, expected, actual``.
    """
    raw, names = _text_columns(spark, path, options)
    kinds = dict(kinds or {})
    unknown = [k for k in kinds if k not in names or kinds[k] not in KINDS]
    if unknown:
        raise ValueError(f"no such column or kind: {unknown}; columns are {names}, kinds {list(KINDS)}")
    open_ = [n for n in names if n not in kinds]
    if open_:
        kinds |= {r["column"]: r["kind"] for r in guess_kinds(raw, open_).collect()}  # one row a column
    kinds = {n: kinds[n] for n in names}
    return raw.select(*[converted(_cell(n), k).alias(n) for n, k in kinds.items()]), _problems(raw, kinds)
