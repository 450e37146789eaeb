"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of ``SIZES`` characters in it
(Latin capitals lowered), hashed into ``2**SLOT_BITS`` slots.  From the
training texts each slot gets its log-count ratio, log of how often toxic
texts hold it over how often others do, smoothed.  Every slot whose association with the label is
beyond chance (likelihood-ratio statistic of at least ``STRENGTH``) is kept, however many they are, a text's
vector holds the ratio of each kept slot that it has, and a logistic
regression is fitted on those vectors.  Its regularisation is ``PENALTIES``; of several, the one that predicts a held-back
fifth of the training texts best, with slots and ratios of the other four (a fit each).  Scores are probabilities under the
shares of the two labels among all labelled rows.

The fit uses a bounded sample: the ``per_label`` rows of each label with the
least hash of their id.  Scoring covers every character of every text.

Defined results.  Null or empty text has no features; its score is that of the
intercept.  Without rows of both labels the score is the smoothed share of
toxic ones.  Rows without an id or a label do not train.  A document labelled
with both marks trains with both; equal texts with one mark train once and get
equal scores.  Other columns are
kept and may have any name but those that begin with ``tox_``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stage_table
from .kernels import lists, powers, row_slices, running, text_bytes

SIZES = (3, 4, 5)
SLOT_BITS = 20
PER_LABEL = 4000
#: Twice the log-likelihood gained by telling the labels apart by one slot: 5 % by chance.
STRENGTH = 3.84
PENALTIES = (1e-3,)
_VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xC4CEB9FE1A85EC53)
#: Lower case of the Latin letters below U+0250 that have one, a character for a character.
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x250)], np.uint32)


@dataclass(frozen=True)
class Model:
    slots: np.ndarray
    weights: np.ndarray
    intercept: float


def _characters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of consecutive texts, and where each text begins."""
    begins = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    latin = points < len(_LOWER)
    points = np.where(latin, _LOWER[np.where(latin, points, 0)], points)
    return points, np.minimum(begins[offsets], len(points))


def _slots(text: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text, slot)`` pairs by text, of the ``wanted`` slots if given."""
    points, first = _characters(*text_bytes(text))
    sums = running(points.astype(np.uint64) + np.uint64(1), _BASE)
    inverse = powers(_BASE, len(sums))[1]
    found = []
    for n in SIZES:
        hashes = (sums[n:] - sums[:-n]) * inverse[:len(sums) - n] if len(points) >= n else np.zeros(0, np.uint64)
        slot = ((hashes ^ (hashes >> np.uint64(32))) * (_SPREAD + np.uint64(2 * n)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at = np.arange(len(slot)) if wanted is None else np.flatnonzero(wanted[slot])
        of = np.searchsorted(first, at, "right") - 1
        inside = at + n <= first[of + 1]
        found.append(of[inside] << SLOT_BITS | slot[at[inside]])
    pairs = np.concatenate(found)
    of = pairs >> SLOT_BITS
    order = np.argsort(of, kind="stable")
    of, slot = of[order], (pairs & ((1 << SLOT_BITS) - 1))[order]
    # Of a slot's places in a text the last one written stays: no sort of the pairs.
    seen, keep = np.empty(1 << SLOT_BITS, np.int32), np.empty(len(slot), bool)
    cuts = np.flatnonzero(np.diff(of)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
        own, at = slot[lo:hi], np.arange(hi - lo, dtype=np.int32)
        seen[own] = at
        np.equal(seen[own], at, out=keep[lo:hi])
    return of[keep], slot[keep]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each label hold each slot, summed over the partition."""
    total = np.zeros((2, 1 << SLOT_BITS), np.int64)
    for batch in batches:
        for lo, n in row_slices(batch.column(1)):
            part = batch.slice(lo, n)
            toxic = part.column(0).to_numpy().astype(np.int64)
            of, slot = _slots(part.column(1))
            for k in (0, 1):
                total[k] += np.bincount(slot[toxic[of] == k], minlength=1 << SLOT_BITS)
    slot = np.flatnonzero(total.any(axis=0))
    for at in np.array_split(slot, max(1, len(slot) // 50_000)):
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[0, at]), pa.array(total[1, at])],
                                         ["slot", "clean", "toxic"])


def _vectors(known):
    """``label, features``: sparse vectors in the form that they are stored in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ratio = known.value
        for batch in batches:
            for lo, n in row_slices(batch.column(1)):
                part = batch.slice(lo, n)
                of, slot = _slots(part.column(1), place >= 0)
                counts = np.bincount(of, minlength=n)
                at = place[slot][np.lexsort((slot, of))]
                vector = pa.StructArray.from_arrays(
                    [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(ratio), np.int32)),
                     lists(counts, pa.array(at, pa.int32())), lists(counts, pa.array(ratio[at]))],
                    names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.float64()), vector], ["label", "features"])
    return run


def _kept_slots(sample: DataFrame, clean: float, toxic: float, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a sample with so many texts of each label that tell them apart, in order, and their log-count ratios."""
    counts = sample.select("toxic", "text").mapInArrow(_count, "slot long, clean long, toxic long").groupBy("slot").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a, b, n = F.col("toxic"), F.col("clean"), clean + toxic
    term = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    both, rest = a + b, F.lit(n) - a - b
    gained = 2 * (term(a, both * (toxic / n)) + term(b, both * (clean / n))
                  + term(toxic - a, rest * (toxic / n)) + term(clean - b, rest * (clean / n)))
    # 2 ** SLOT_BITS numbers at most.
    kept = counts.where(gained >= strength).select("slot", F.log(((a + 1) / (toxic + 1)) / ((b + 1) / (clean + 1))).alias("ratio")).toArrow()
    slot, ratio = kept.column("slot").to_numpy(), kept.column("ratio").to_numpy()
    order = np.argsort(slot)
    return slot[order], ratio[order]


def _as_vectors(sample: DataFrame, slots: np.ndarray, ratio: np.ndarray) -> DataFrame:
    """Staged ``label, features`` of the sample's texts."""
    spark = sample.sparkSession
    place = np.full(1 << SLOT_BITS, -1, np.int32)
    place[slots] = np.arange(len(slots))
    rows = stage_table(sample.select("toxic", "text").mapInArrow(_vectors(spark.sparkContext.broadcast((place, ratio))),
                                                                 f"label double, features {_VECTOR}"), "tox-vectors")
    # The same files, with the structs as the vectors that they are.
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(rows._staged_path)


def _fit(rows: DataFrame, penalty: float):
    return LogisticRegression(maxIter=60, regParam=penalty, standardization=False).fit(rows)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, strength: float = STRENGTH,
          penalties: Sequence[float] = PENALTIES) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic: 0 or 1)."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = math.log((share.get(1, 0) + 0.5) / (share.get(0, 0) + 1.5))
    chosen = [labels.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for k in (0, 1)]
    chosen = stage_table(chosen[0].unionByName(chosen[1]), "tox-chosen", small=True)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * per_label rows
    sample = sample.select("toxic", F.coalesce("text", F.lit("")).alias("text")).distinct()
    back = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(5)) == 0
    sample = stage_table(sample.withColumn("back", back).repartition(2 * docs.sparkSession.sparkContext.defaultParallelism), "tox-sample")
    held = {(r["toxic"], r["back"]): r["n"] for r in sample.groupBy("toxic", "back").agg(F.count("*").alias("n")).collect()}
    clean, toxic = (float(held.get((k, False), 0) + held.get((k, True), 0)) for k in (0, 1))
    if not (clean and toxic):
        return Model(np.zeros(0, np.int64), np.zeros(0), prior)
    penalty = penalties[len(penalties) // 2]
    if len(held) == 4 and len(penalties) > 1:
        rest = sample.where(~F.col("back"))
        slots, ratio = _kept_slots(rest, float(held[0, False]), float(held[1, False]), strength)
        if len(slots):
            rows, judges = _as_vectors(rest, slots, ratio).cache(), _as_vectors(sample.where("back"), slots, ratio)
            sure = F.get(vector_to_array("probability"), F.col("label").cast("int"))
            lost = {p: _fit(rows, p).transform(judges).agg(F.avg(-F.log(F.greatest(sure, F.lit(1e-12))))).first()[0] for p in penalties}
            rows.unpersist()
            penalty = min(penalties, key=lambda p: (lost[p], -p))
    slots, ratio = _kept_slots(sample, clean, toxic, strength)
    if not len(slots):
        return Model(slots, ratio, prior)
    fitted = _fit(_as_vectors(sample, slots, ratio), penalty)
    return Model(slots, np.array(fitted.coefficients.toArray()) * ratio,
                 float(fitted.intercept) + prior - math.log(toxic / clean))


def _scored(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        weight = np.zeros(1 << SLOT_BITS)
        weight[model.slots] = model.weights
        wanted = weight != 0
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for lo, n in row_slices(text):
                part = batch.slice(lo, n)
                of, slot = _slots(part.column(batch.schema.get_field_index("text")), wanted)
                margin = model.intercept + np.bincount(of, weights=weight[slot], minlength=n)
                score = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "tox_score"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``tox_score``, the probability of label 1."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scored(known), T.StructType([*docs.schema.fields, T.StructField("tox_score", T.DoubleType())]))
