"""Publish the pipeline's tables once; serve the apps' slices from them.

The reference's apps run their whole ETL at start and then filter the same
tables on every input change.  Here the fact tables are written once as
Parquet (to the cluster's shared checkpoint folder unless told otherwise)
and every slice is a scan of those files:

* the map table is partitioned by ``variable_type`` and sorted by year
  within each file, so ``map_slice`` reads one directory and skips row
  groups by their year statistics;
* the dashboard fact table is sorted by ``(state, disaster, year)`` so the
  three dashboard filters skip row groups the same way.

Writing goes through Spark's file commit protocol, so a lost executor only
re-runs its own tasks.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from ..sources.sinks import write_table
from .driver import DriverPipeline


def default_dir(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark).replace("file:", ""), "published")


def publish_tables(p: DriverPipeline, out_dir: str | None = None) -> dict[str, str]:
    """Write the climate and count tables once, and build the published ones from those files."""
    out_dir = out_dir or default_dir(p.spark)
    paths = {name: os.path.join(out_dir, name) for name in ("climate", "counts", "dash", "fact_b", "regional", "map")}
    write_table(p.climate, paths["climate"])
    write_table(p.counts, paths["counts"])
    # Plans that are built from here on read the files.
    p.__dict__.update(climate=p.spark.read.parquet(paths["climate"]), counts=p.spark.read.parquet(paths["counts"]))
    for name in ("totals", "fact_a", "fact_b", "dash", "regional", "regional_type", "map_table"):
        p.__dict__.pop(name, None)
    write_table(p.dash.sortWithinPartitions("state", "disaster", "year"), paths["dash"])
    write_table(p.fact_b, paths["fact_b"])
    write_table(p.regional, paths["regional"])
    # By ranges: a variable's rows are dealt to several tasks, each of which writes a few files.
    write_table(p.map_table.repartitionByRange("variable_type", "year", "state_code").sortWithinPartitions("variable_type", "year", "state_code"),
                paths["map"], partition_by=["variable_type"])
    return paths


def read_published(spark: SparkSession, paths: dict[str, str], name: str) -> DataFrame:
    return spark.read.parquet(paths[name])
