"""Monte-Carlo cross-validation of the count models.

A row belongs to the test part of split ``s`` when the hash of its key, the
split and the seed is small.  Membership is stable for a seed, needs no shuffle, and the
``split_id`` column of ``with_splits`` is produced by an ``explode``; rows × splits are never written.
By default "small" is the test fraction.  ``exact=True`` gives every split
exactly ``floor(n · test)`` test rows (at least one): the threshold of a split is its
hash of that rank, found by refining histograms (``split_thresholds``), so no
row is ranked and no split meets in one task, whatever the size of the table.

All splits are fitted together: one pass per iteration
(``glm.fit_groups``), not one Spark job per split.  A row is held once, with the splits that test it
(``glm.SplitRows``), and the sums of all splits are taken from it at once.  Each starts from the fit of
the whole table, which its training part is a sample of, so two or three passes do.

``leaky=True`` reproduces the reference: every split's model is fitted on
the whole table (defect D2), which makes all fits identical, so it is fitted
once.  ``scale="link"`` reproduces its error measure, which compares counts
with log-scale predictions (defect D3); the default compares on the count
scale.  ``model_order`` numbers the models as they first appear (``operators/levels.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.levels import with_first_order
from ..session import drop_staged, stage_table
from .design import Formula, as_formula, build_design, complete_rows
from .glm import SplitRows, fit_groups, prepare_rows, split_errors, stable_rows

#: Buckets of one split's histogram in a pass of the refinement.
BINS = 1024
#: The hash's upper bits, so that they are whole numbers of a long that can be divided.
_HASH_BITS = 62
MODELS = (("poisson", "poisson"), ("negative_binomial", "negbin"))


def _hash(key_cols: Sequence[str], seed: int) -> Column:
    h = F.xxhash64(*[F.col(f"`{c}`") for c in key_cols], F.col("split_id"), F.lit(seed))
    return F.shiftrightunsigned(h, 64 - _HASH_BITS)


def _each_split(n_splits: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split_id")


def _rank_value(values: DataFrame, targets: DataFrame) -> DataFrame:
    """``split_id, value, over``: the value of rank ``rank`` (from 0) among a split's ``_v``, and its rank among equal ones.

    ``targets``: ``split_id, rank, lo, hi`` with the interval ``lo..hi`` that holds the value.  A pass counts the values
    of each open interval in ``BINS`` buckets (partial aggregates); a window over one split's buckets picks
    the next interval, the actual range of the bucket that holds the rank.
    """
    done = None
    while True:
        width = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("hi") - F.col("lo") + F.lit(1)) / F.lit(BINS)).cast("long"))
        bucket = F.expr("(_v - lo) div _width")
        hist = (values.join(F.broadcast(targets.withColumn("_width", width)), "split_id")  # one row per split
                .where(F.col("_v").between(F.col("lo"), F.col("hi")))
                .groupBy("split_id", "rank", bucket.alias("_k"))
                .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b")))
        upto = Window.partitionBy("split_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("_cum", F.sum("_n").over(upto))
        hit = hist.where((F.col("_cum") - F.col("_n") <= F.col("rank")) & (F.col("rank") < F.col("_cum")))
        found = stage_table(hit.select("split_id", (F.col("rank") - F.col("_cum") + F.col("_n")).alias("rank"),
                                       F.col("_a").alias("lo"), F.col("_b").alias("hi"), "_n"), "cv-thresholds", small=True)
        settled = found.where("lo = hi").select("split_id", F.col("lo").alias("value"), F.col("rank").alias("over"), "_n")
        done = settled if done is None else done.unionByName(settled)
        targets = found.where("lo < hi").drop("_n")
        if targets.isEmpty():
            return done


def split_thresholds(rows: DataFrame, key_cols: Sequence[str], n_splits: int, test: float, seed: int) -> list[tuple[int, int, int]]:
    """``(split, hash, row)``: a row is in the test part up to that hash, and among equal ones up to that ``_row``.

    ``rows`` is a staged table with a number ``_row`` of each row, which only decides between rows of equal keys.
    """
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        return []
    k = max(int(n * test + 1e-9), 1)
    values = rows.select(*key_cols, "_row", _each_split(n_splits)).select("split_id", "_row", _hash(key_cols, seed).alias("_v"))
    every = spark.range(n_splits).select(F.col("id").cast("int").alias("split_id"), F.lit(k - 1).cast("long").alias("rank"),
                                         F.lit(0).cast("long").alias("lo"), F.lit((1 << _HASH_BITS) - 1).cast("long").alias("hi"))
    found = _rank_value(values, every)
    rank = {r["split_id"]: (r["value"], r["over"], r["_n"]) for r in found.collect()}  # one row per split
    last = {s: (1 << 62) for s in rank}
    tied = {s: (v, over) for s, (v, over, m) in rank.items() if over + 1 < m}
    if tied:
        top = rows.agg(F.max("_row")).first()[0]
        cut = spark.createDataFrame([(s, int(v)) for s, (v, _) in tied.items()], "split_id int, _t long")
        equal = values.join(F.broadcast(cut), "split_id").where("_v = _t").select("split_id", F.col("_row").alias("_v"))
        ask = spark.createDataFrame([(s, int(over), 0, int(top)) for s, (_, over) in tied.items()],
                                    "split_id int, rank long, lo long, hi long")
        last |= {r["split_id"]: r["value"] for r in _rank_value(equal, ask).collect()}
    return [(s, int(v), int(last[s])) for s, (v, _, _) in sorted(rank.items())]


_THRESHOLDS = T.StructType([T.StructField("split_id", T.IntegerType()), T.StructField("_t", T.LongType()), T.StructField("_last", T.LongType())])


def _test_splits(key_cols: Sequence[str], n_splits: int, test: float, seed: int, cut: Sequence[tuple[int, int, int]] | None = None) -> Column:
    """The splits that have the row in their test part; ``cut``: the thresholds of exact ones."""
    keys = [F.col(f"`{c}`") for c in key_cols]

    def is_test(split: Column) -> Column:
        h = F.shiftrightunsigned(F.xxhash64(*keys, split, F.lit(seed)), 64 - _HASH_BITS)
        if cut is None:
            return h < F.lit(int(test * (1 << _HASH_BITS))).cast("long")
        upto, last = (F.array(*[F.lit(c[k]).cast("long") for c in cut])[split] for k in (1, 2))
        return (h < upto) | ((h == upto) & (F.col("_row") <= last))

    every = F.sequence(F.lit(0), F.lit(n_splits - 1))
    return F.filter(every, is_test) if cut is None or cut else F.filter(every, lambda s: F.lit(False))


def with_splits(df: DataFrame, key_cols: Sequence[str], n_splits: int = 100,
                test: float = 0.2, seed: int = 1, exact: bool = False) -> DataFrame:
    """Rows × splits with a stable ``is_test`` flag.

    Default: each row is in a split's test part with probability ``test``.  ``exact=True`` gives every
    split exactly ``floor(n · test)`` test rows (at least one), those with the smallest hashes;
    the table is staged for that, as several passes read it.
    """
    if not exact:
        rows = df.select("*", _each_split(n_splits))
        return rows.withColumn("is_test", _hash(key_cols, seed) < F.lit(int(test * (1 << _HASH_BITS))).cast("long"))
    if "_row" not in df.columns:
        df = stage_table(df.withColumn("_row", F.monotonically_increasing_id()), "cv-rows")
    cut = df.sparkSession.createDataFrame(split_thresholds(df, key_cols, n_splits, test, seed), _THRESHOLDS)
    rows = df.select("*", _each_split(n_splits)).join(F.broadcast(cut), "split_id")  # one row per split
    h = _hash(key_cols, seed)
    flag = (h < F.col("_t")) | ((h == F.col("_t")) & (F.col("_row") <= F.col("_last")))
    return rows.withColumn("is_test", flag).drop("_t", "_last", "_row")


def split_sizes(df: DataFrame, key_cols: Sequence[str], n_splits: int = 100,
                test: float = 0.2, seed: int = 1, exact: bool = False) -> DataFrame:
    return (with_splits(df.select(*key_cols), key_cols, n_splits, test, seed, exact)
            .groupBy("split_id")
            .agg(F.sum(F.when(~F.col("is_test"), 1).otherwise(0)).cast("long").alias("n_train"),
                 F.sum(F.when(F.col("is_test"), 1).otherwise(0)).cast("long").alias("n_test")))


def cv_errors(df: DataFrame, formula: Formula | str, key_cols: Sequence[str], n_splits: int = 100, test: float = 0.2,
              seed: int = 1, leaky: bool = False, scale: str = "response", exact: bool = False) -> DataFrame:
    """Test RMSE per split and model: ``split_id, model, model_order, rmse``."""
    formula = as_formula(formula)
    rows = complete_rows(df, formula, key_cols)
    if exact:
        numbered = stage_table(rows.withColumn("_row", F.monotonically_increasing_id()), "cv-rows")
        cut = split_thresholds(numbered, key_cols, n_splits, test, seed)
        base = stable_rows(numbered.withColumn("_out", _test_splits(key_cols, n_splits, test, seed, cut)))
        drop_staged(numbered)
    else:
        base = stable_rows(rows.withColumn("_out", _test_splits(key_cols, n_splits, test, seed)))
    try:
        design = build_design(base, formula)
        split_rows = SplitRows(prepare_rows(base, design, others=["_out"]), n_splits)
        # Both models from one set of passes: the negative binomial starts from the Poisson fit of the same split.
        whole = fit_groups(prepare_rows(base, design), design, "both", groups=[0], standard_errors=False)
        if leaky:
            fits = dict.fromkeys(range(n_splits), whole[0]) if whole else {}
        else:
            fits = fit_groups(split_rows, design, "both", groups=range(n_splits), initial=whole.get(0), standard_errors=False)
        found = split_errors(split_rows, [{s: f[family].beta_scaled for s, f in fits.items()} for _, family in MODELS], scale == "link")
        label = F.element_at(F.array(*[F.lit(name) for name, _ in MODELS]), F.col("model") + 1)
        errors = found.select(F.col("_g").cast("int").alias("split_id"), F.col("model").alias("_column"), label.alias("model"),
                              F.sqrt(F.col("sq") / F.col("n")).alias("rmse"))
        errors = stage_table(errors, "cv-errors", small=True)  # one row per split and model
    finally:
        base.unpersist()
        drop_staged(base)
    # A split's errors come in the order of its models' columns.
    out = with_first_order(errors, "model", "model_order", ["split_id", "_column"])
    return out.select("split_id", "model", "model_order", "rmse")
