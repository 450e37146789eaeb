"""CSV readers for the reference's two source kinds.

Both readers declare their schema; nothing is inferred.  Files must already
sit on a filesystem Spark can read (the reference downloads them over HTTP;
that staging step is outside Spark).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_names

# Layout of a monthly climate series file without a header.  With one, it is
# three preamble lines, the header line, then one row per place and month.
CLIMATE_COLUMNS = ("location", "date", "value")


def climate_schema(columns: Sequence[str] = CLIMATE_COLUMNS) -> T.StructType:
    fields = []
    for c in columns:
        typ = T.DoubleType() if c == "value" else T.StringType()
        fields.append(T.StructField(c, typ, True))
    return T.StructType(fields)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files behind a path, glob or folder of part files, by the name Spark's readers give them."""
    return sorted(spark.read.text(path).inputFiles())


def _headers(spark: SparkSession, files: Sequence[str]) -> dict[str, list[str]]:
    """The cleaned names of each file's header: its first line that names a date and a value, however far down.

    One job for all files.  A task keeps the first such line of each of its blocks, so what reaches the driver is
    one line a block at most and, after the aggregate, one line a file.
    """
    lines = spark.read.text(list(files)).select(
        "value", F.input_file_name().alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    # A cheap test first; the names are then cleaned as the reader would clean them.
    likely = lines.where(F.lower("value").contains("date") & F.lower("value").contains("value")
                         & F.col("value").rlike(r"(?i)(^|,)[\s\"]*date[\s\"]*(,|$)") & F.col("value").rlike(r"(?i)(^|,)[\s\"]*value[\s\"]*(,|$)"))
    first = likely.groupBy("file").agg(F.min_by("value", "at").alias("line")).collect()
    return {r["file"]: clean_names([x.strip().strip('"') for x in r["line"].split(",")]) for r in first}


def read_climate_csv(spark: SparkSession, paths: str | Sequence[str] | Mapping[str, str],
                     columns: Sequence[str] | None = None) -> DataFrame:
    """Read monthly series as ``(location, date, value)`` (+ ``series`` tag).

    Columns are taken by the names in each file's header (its first line that names a date and a
    value; files with the same header are read together), or by the
    order given in ``columns``.  A file without a header needs ``columns``.
    Preamble lines and header are then dropped by keeping only rows whose
    ``date`` is six digits: this needs no line numbers, so every file split is
    read in parallel.  ``NA`` text is read as null.

    A path may be a file, a folder of part files or a glob.  A mapping
    ``{series_name: path}`` reads each series by itself and tags its rows with
    its name, whatever its files are called.
    """
    if isinstance(paths, Mapping):
        parts = [read_climate_csv(spark, path, columns).select(F.lit(name).alias("series"), "location", "date", "value")
                 for name, path in paths.items()]
        return reduce(DataFrame.unionByName, parts)
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path in [paths] if isinstance(paths, str) else paths:
        if columns is not None:
            layouts.setdefault(tuple(columns), []).append(path)
            continue
        files = _files(spark, path)
        headers = {unquote(f): names for f, names in _headers(spark, files).items()} if files else {}
        for file in files:
            names = headers.get(unquote(file))
            if names is None:
                raise ValueError(f"climate file {file} has no header that names a date and a value; give its columns")
            layouts.setdefault(tuple(names), []).append(file)
    out = None
    for layout, files in layouts.items():
        missing = {"location", "date", "value"} - set(layout)
        if missing:
            raise ValueError(f"climate file {files[0]} has no column {', '.join(sorted(missing))}: {list(layout)}")
        df = (spark.read.schema(climate_schema(layout)).option("header", "false").option("nullValue", "NA")
              .option("mode", "PERMISSIVE").csv(files)
              .where(F.col("date").rlike("^[0-9]{6}$")).select("location", "date", "value"))
        out = df if out is None else out.unionByName(df)
    return spark.createDataFrame([], climate_schema()) if out is None else out


DECLARATION_COLUMNS = ("state", "incident_type", "fy_declared")


def read_declarations_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Read declaration records as ``(state, incident_type, fy_declared)``.

    The file has a header and many columns; all are read as text (no
    inference), names are cleaned to snake_case, and the year is converted
    with ``try_cast`` so bad text becomes null instead of failing the job.
    """
    raw = (spark.read.option("header", "true").option("quote", '"').option("escape", '"')
           .option("nullValue", "NA").option("inferSchema", "false")
           .csv(path if isinstance(path, str) else list(path)))
    df = with_clean_names(raw)
    return df.select(
        F.col("state").cast("string"),
        F.col("incident_type").cast("string"),
        F.expr("try_cast(fy_declared AS INT)").alias("fy_declared"),
    )


def with_clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake_case (metadata only, no data pass)."""
    return df.toDF(*clean_names(df.columns))
