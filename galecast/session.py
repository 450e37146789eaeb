"""Spark session helpers.

The library never creates a session behind the caller's back: every public
function takes a ``SparkSession`` (or a DataFrame).  These helpers exist for
tests, the bench and scripts that start Spark themselves.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at any scale.  AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed join partitions, which
# is what protects the big orders/lineitem joins from a hot key.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "galecast", driver_memory: str = "8g",
                  extra: dict | None = None) -> SparkSession:
    """A ``local[cores]`` session for tests and the bench."""
    parts = shuffle_partitions or (8 if cores == "*" else int(cores))
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.driver.memory", driver_memory)
               .config("spark.sql.shuffle.partitions", str(parts)))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only a local master may do without: executors then share this
    machine's scratch folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="galecast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not context.getCheckpointDir():
        context.setCheckpointDir(current)
    return context.getCheckpointDir()


def stage_table(df: DataFrame, label: str = "stage", small: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder and read it back.

    This cuts the lineage like a reliable checkpoint but computes the plan in
    a single job (an eager ``checkpoint`` counts the rows in one job and then
    recomputes the plan to write them).  The files sit on the cluster's shared
    storage, so a lost executor costs a re-read of its files, and the read-back
    scan prunes columns and pushes filters like any table.

    ``small`` says that the last step is cheap and its result a small share of
    the data: ``FILES_PER_CORE`` files per core at most then hold it, however
    many shuffle partitions there are.  A task writes the results of several,
    one after another, which takes no more memory.

    Tables go when they are dropped (``drop_staged``), or else with the session.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{label}-{uuid.uuid4().hex}"
    out = df.coalesce(max(1, FILES_PER_CORE * spark.sparkContext.defaultParallelism)) if small else df
    out.write.mode("errorifexists").parquet(path)
    if not _staged:
        atexit.register(_drop_all)
    _staged[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


FILES_PER_CORE = 2
_staged: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path in _staged:
        _delete(_staged.pop(path), path)


def _drop_all() -> None:
    for path, spark in list(_staged.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S110  the session has ended; its folder is the cluster's to clear
            return
        _staged.pop(path, None)
