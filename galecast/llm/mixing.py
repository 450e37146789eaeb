"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight,
``-ln(u) / w`` with ``u`` a hash of its id and text, so that smaller keys are
likelier for better documents and reruns agree.  A source whose target is at
least its own size is first taken whole, as often as it fits (complete
epochs); what is left of the target is a prefix of its documents in key
order, ended where the prefix sum of the sizes comes nearest to the budget.

The order is never made in one task: keys are counted in ``KEY_BUCKETS``
buckets per source, the bucket that holds the budget is found by a prefix sum
over those counts and cut into buckets again, until it has ``SORT_ROWS`` rows at most or one key;
then it is sorted.  The outcome is one cut per
source, and whether a document is taken is a comparison with its source's cut.
Rows equal in id and text share their key; where the cut falls among them, as many are taken as
come nearest to the budget, the first by a number that each row gets when the rows are staged.

Defined results.  Null text: size 0.  Null source: a source of its own, last
in the order of sources.  Null ids are hashed like the empty string.  A source
without words has target 0 and none of its rows is taken.  An empty table
gives an empty result.  Documents missing from the quality table, or with a
null there, weigh ``NEUTRAL``.  Other columns are kept and may have any name
but those that begin with ``mix_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stage_table

WORD = r"[^\x20\x09-\x0D]+"
KEY_BUCKETS, SORT_ROWS = 1024, 100_000
#: Quality weight of a document by its mean label: 0 gives LOW, 1 gives HIGH.
LOW, HIGH, NEUTRAL = 0.5, 2.0, 1.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A hash of the row in (0, 1]; 48 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"),
                            F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / float(2 ** 48)


def _with_keys(docs: DataFrame, seed: int) -> DataFrame:
    """Add ``mix_size, mix_u`` from the text; nothing here needs a shuffle."""
    return (docs.withColumn("mix_size", word_count(F.col("text")))
            .withColumn("mix_u", _uniform(F.col("doc_id"), F.col("text"), seed)))


def _weigh(rows: DataFrame, quality: DataFrame | None) -> DataFrame:
    """Add ``mix_key, mix_bucket``: the exponential key and its bucket, both in the same order."""
    if quality is None:
        rows = rows.withColumn("mix_w", F.lit(NEUTRAL))
    else:
        marks = (quality.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("mix_id"))
                 .agg(F.avg("quality").alias("mix_q")))
        rows = (rows.join(marks, rows["doc_id"] == marks["mix_id"], "left")
                .withColumn("mix_w", F.coalesce(F.lit(LOW) + F.lit(HIGH - LOW) * F.col("mix_q"), F.lit(NEUTRAL)))
                .drop("mix_id", "mix_q"))
    return (rows.withColumn("mix_key", -F.log("mix_u") / F.col("mix_w"))
            .withColumn("mix_bucket", F.least(F.floor((1 - F.exp(-F.col("mix_key"))) * KEY_BUCKETS),
                                              F.lit(KEY_BUCKETS - 1)).cast("int"))
            .drop("mix_w", "mix_u"))


def source_targets(sizes: DataFrame, weights: Sequence[float], ratio: float, epochs: float) -> DataFrame:
    """``source, source_size`` to those plus ``target``: one row per source.

    Sharing out by weight with a ceiling per source and resharing the excess
    until none is above has one fixed point: a common level of target per
    weight.  In the order of ceiling per weight, a source is at its ceiling as
    long as that is below the level the rest would have, so two running sums
    give the level: that of the first source above it, and the greatest.  The table has one row per source, never per document.
    """
    everything = W.partitionBy()
    n = len(weights)
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("mix_place") % n + 1).cast("int"))
    before = W.orderBy("mix_ratio", "mix_place").rowsBetween(W.unboundedPreceding, -1)
    return (sizes.withColumn("mix_place", place).withColumn("mix_weight", weight)
            .withColumn("mix_cap", F.col("source_size") * float(epochs))
            .withColumn("mix_ratio", F.col("mix_cap") / F.col("mix_weight"))
            .withColumn("mix_level",
                        (F.sum("source_size").over(everything) * float(ratio)
                         - F.coalesce(F.sum("mix_cap").over(before), F.lit(0.0)))
                        / (F.sum("mix_weight").over(everything)
                           - F.coalesce(F.sum("mix_weight").over(before), F.lit(0.0))))
            .withColumn("mix_open", F.col("mix_ratio") > F.col("mix_level"))
            .withColumn("mix_level", F.max(F.when(F.col("mix_open"), F.col("mix_level"))).over(everything))
            .withColumn("target", F.when(F.col("mix_open"), F.col("mix_level") * F.col("mix_weight"))
                        .otherwise(F.col("mix_cap")))
            .select("source", "source_size", "target"))


def source_cuts(rows: DataFrame, weights: Sequence[float], ratio: float, epochs: float) -> DataFrame:
    """One row per source: ``mix_source, source_size, target, mix_epochs, mix_from, mix_cut_key, mix_cut_row``.

    Taken beyond the epochs are the rows with a key below ``mix_from`` or up to the cut's, of those with the cut's key
    the ones up to ``mix_cut_row`` if it is not null.  ``rows`` is a staged table whose ``mix_row`` numbers its rows.
    """
    found = (F.sum("mix_size").alias("mix_size"), F.count(F.lit(1)).alias("mix_n"), F.min("mix_key").alias("mix_from"),
             F.max("mix_key").alias("mix_to"))
    per_bucket = rows.groupBy("source", "mix_bucket").agg(*found)
    sizes = per_bucket.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    shares = (source_targets(sizes, weights, ratio, epochs)
              .withColumn("mix_epochs", F.when(F.col("source_size") > 0,
                                               F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
              .withColumn("mix_left", F.col("target") - F.col("mix_epochs") * F.col("source_size"))
              .withColumnRenamed("source", "mix_source"))
    runs = per_bucket.join(shares.select("mix_source", "mix_left"), F.col("source").eqNullSafe(F.col("mix_source"))).drop("source")
    edge = stage_table(_edge(runs), "mix-edges", small=True)
    while not (wide := edge.where((F.col("mix_n") > SORT_ROWS) & (F.col("mix_from") < F.col("mix_to")))).isEmpty():
        bucket = F.floor((F.col("mix_key") - F.col("mix_from")) / (F.col("mix_to") - F.col("mix_from")) * KEY_BUCKETS)
        finer = (_in_edge(rows, wide).groupBy("mix_source", "mix_left", F.least(bucket, F.lit(KEY_BUCKETS - 1)).cast("int").alias("mix_bucket"))
                 .agg(*found))
        rest = edge.where((F.col("mix_n") <= SORT_ROWS) | (F.col("mix_from") >= F.col("mix_to")))
        edge = stage_table(rest.unionByName(_edge(finer)), "mix-edges", small=True)
    inside = _in_edge(rows, edge).groupBy("mix_source", "mix_left", "mix_from", "mix_key").agg(
        F.sum("mix_size").alias("mix_size"), F.count(F.lit(1)).alias("mix_n"))
    running = W.partitionBy("mix_source").orderBy("mix_key").rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("mix_room", F.col("mix_left") - F.sum("mix_size").over(running) + F.col("mix_size"))
    # How many rows of a key come nearest to what is left.
    each = F.col("mix_size") / F.col("mix_n")
    fit = F.when(each > 0, F.floor((2 * F.col("mix_room") + each) / (2 * F.nullif(each, F.lit(0.0))))).otherwise(
        F.when(F.col("mix_room") >= 0, F.col("mix_n")).otherwise(0))
    inside = inside.withColumn("mix_fit", F.least(F.greatest(fit, F.lit(0)), F.col("mix_n")).cast("long"))
    last = inside.groupBy("mix_source", "mix_from").agg(
        F.max(F.when(F.col("mix_fit") > 0, F.struct("mix_key", "mix_fit", "mix_n"))).alias("mix_last"))
    last = stage_table(last.select(F.col("mix_source").alias("mix_edge_source"), "mix_from", F.col("mix_last.mix_key").alias("mix_cut_key"),
                                   F.col("mix_last.mix_fit").alias("mix_fit"), F.col("mix_last.mix_n").alias("mix_n")), "mix-last", small=True)
    split = last.where(F.col("mix_fit") < F.col("mix_n"))
    if split.isEmpty():
        last = last.withColumn("mix_cut_row", F.lit(None).cast("long"))
    else:
        cut = _cut_rows(rows, split).withColumnRenamed("mix_edge_source", "mix_cut_source")
        last = last.join(cut, F.col("mix_edge_source").eqNullSafe(F.col("mix_cut_source")), "left").drop("mix_cut_source")
    return (shares.join(last, shares["mix_source"].eqNullSafe(last["mix_edge_source"]), "left")
            .drop("mix_edge_source", "mix_left", "mix_fit", "mix_n"))


def _edge(runs: DataFrame) -> DataFrame:
    """Per source the bucket that holds what is left, with what is left in it: ``mix_source, mix_from, mix_to, mix_left, mix_n``."""
    upto = F.sum("mix_size").over(W.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(W.unboundedPreceding, 0))
    return (runs.withColumn("mix_upto", upto)
            .where((F.col("mix_upto") - F.col("mix_size") < F.col("mix_left")) & (F.col("mix_upto") >= F.col("mix_left")))
            .select("mix_source", "mix_from", "mix_to", (F.col("mix_left") - F.col("mix_upto") + F.col("mix_size")).alias("mix_left"), "mix_n"))


def _in_edge(rows: DataFrame, edge: DataFrame) -> DataFrame:
    narrow = rows.select("source", "mix_size", "mix_key")
    return narrow.join(edge.drop("mix_n"), F.col("source").eqNullSafe(F.col("mix_source")) & F.col("mix_key").between(F.col("mix_from"), F.col("mix_to")))


def _cut_rows(rows: DataFrame, split: DataFrame) -> DataFrame:
    """``mix_edge_source, mix_cut_row``: the ``mix_fit``-th row number among the rows of the cut's key.

    Row numbers begin with the partition that staged the row, so equal rows, however many, are counted by
    partition first, and only those of one partition are sorted.
    """
    ties = rows.select("source", "mix_key", "mix_row").join(
        split.select("mix_edge_source", "mix_cut_key", "mix_fit"),
        F.col("source").eqNullSafe(F.col("mix_edge_source")) & (F.col("mix_key") == F.col("mix_cut_key")))
    ties = ties.select("mix_edge_source", "mix_fit", "mix_row", F.shiftright("mix_row", 33).alias("mix_part"))
    parts = ties.groupBy("mix_edge_source", "mix_fit", "mix_part").agg(F.count(F.lit(1)).alias("mix_n"))
    upto = F.sum("mix_n").over(W.partitionBy("mix_edge_source").orderBy("mix_part").rowsBetween(W.unboundedPreceding, 0))
    edge = (parts.withColumn("mix_upto", upto)
            .where((F.col("mix_upto") - F.col("mix_n") < F.col("mix_fit")) & (F.col("mix_upto") >= F.col("mix_fit")))
            .select(F.col("mix_edge_source").alias("mix_of"), F.col("mix_part").alias("mix_in"),
                    (F.col("mix_fit") - F.col("mix_upto") + F.col("mix_n")).alias("mix_th")))
    inside = ties.join(edge, F.col("mix_edge_source").eqNullSafe(F.col("mix_of")) & (F.col("mix_part") == F.col("mix_in")))
    number = F.row_number().over(W.partitionBy("mix_edge_source").orderBy("mix_row"))
    return inside.withColumn("mix_number", number).where("mix_number = mix_th").select("mix_edge_source", F.col("mix_row").alias("mix_cut_row"))


def _apply(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    whole = F.col("mix_cut_row").isNull() | (F.col("mix_row") <= F.col("mix_cut_row"))
    extra = (F.col("mix_key") < F.col("mix_from")) | (F.col("mix_key") < F.col("mix_cut_key")) | ((F.col("mix_key") == F.col("mix_cut_key")) & whole)
    return (rows.join(cuts, rows["source"].eqNullSafe(cuts["mix_source"]))
            .withColumn("mix_copies", F.col("mix_epochs") + F.coalesce(extra, F.lit(False)).cast("int")))


def mix_plan(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = (3, 1, 2),
             ratio: float = 1.5, epochs: float = 2, seed: int = 7) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    The text is read once; the keys and sizes are staged as a narrow table.
    """
    narrow = _with_keys(docs, seed).select("doc_id", "source", "mix_size", "mix_u")
    rows = stage_table(_weigh(narrow, quality).withColumn("mix_row", F.monotonically_increasing_id()), "mix")
    cuts = stage_table(source_cuts(rows, weights, ratio, epochs), "mix-cuts", small=True)
    return _apply(rows, cuts).select(
        "doc_id", "source", F.col("mix_size").alias("size"), "source_size", "target",
        F.col("mix_copies").alias("copies"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = (3, 1, 2),
        ratio: float = 1.5, epochs: float = 2, seed: int = 7) -> DataFrame:
    """The mixed corpus: ``docs``' own columns, each document as often as the mix takes it.

    The rows are staged with their texts, so that each has one number in all steps.
    """
    keyed = _weigh(_with_keys(docs, seed), quality).withColumn("mix_row", F.monotonically_increasing_id())
    rows = stage_table(keyed, "mix")
    cuts = stage_table(source_cuts(rows, weights, ratio, epochs), "mix-cuts", small=True)
    return (_apply(rows, cuts.drop("source_size", "target")).where(F.col("mix_copies") > 0)
            .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
            .select(*docs.columns))
