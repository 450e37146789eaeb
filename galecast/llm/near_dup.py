"""Near duplicates by MinHash bands and odd sketches.

A document's set holds its distinct shingles (runs of ``words`` words, ASCII
lower case; a shorter text is one shingle).  Documents with equal sets form a
class; everything after that works on classes, so thousands of copies are one
row.  ``SAMPLES`` MinHash values of a set, cut into bands of ``ROWS`` values,
find candidates.  Classes that share a bucket get an odd sketch: ``FOLDED``
MinHash values are folded into a bitmap in which sample i flips the bit that a
hash of (i, value) names.  The population count of the XOR of two sketches
estimates how many samples differ.  A candidate pair goes on if its sizes allow
the threshold and its count is within ``SIGMAS`` deviations of what the
threshold allows, and is then confirmed on the full sets.

No group of candidates is ever paired with itself.  First, each class in a band
bucket is compared with two centres only: the bucket's most popular class (the
one whose buckets hold most classes, as the text that others were copied from
does) and its least id.  Then buckets that still hold several components
compare the members outside their largest component with those of other
components, in a join that adaptive execution can split and whose condition
holds the tests, so that it gives out survivors only, once each.  Pairs inside a
component need no test.  Together every two classes of a bucket are in one
component or have been tested.

With 56 bands of 6, a pair at similarity 0.8 shares no bucket with probability
4e-8, less above; at just 0.8 the sketch test drops 1 pair in 1,000,000,000.

Defined results.  Null or empty text, or text without words: an empty set, no
links.  A null id counts as the greatest; a component of such rows only has a
null id.  Repeated rows are in one class.  ``drop_near_duplicates`` keeps the row
of the smallest id, of several those with the least hash of their text, and of
equal ones one.  Other columns are kept by
``drop_near_duplicates`` and may have any name but those that begin with
``near_``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stage_table
from .components import components
from .kernels import SPACED, Words, mix, row_slices, text_bytes, word_run_hash, word_run_sums

SAMPLES, ROWS = 336, 6
BANDS = SAMPLES // ROWS
FOLDED, BITS = 2048, 4096
SIGMAS = 6.0
_SLOPE = (np.arange(1, FOLDED + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SLOPE, _SHIFT = mix(_SLOPE) | np.uint64(1), mix(_SLOPE + np.uint64(0x5851F42D4C957F2D))


def odd_limit(percent: int, sigmas: float = SIGMAS) -> int:
    """Odd bits that two sets at the threshold reach with a chance beyond ``sigmas`` deviations only.

    Differing samples follow a binomial.  Each flips two bits; of n bits, m
    flips leave n / 2 * (1 - (1 - 2/n)**m) odd on average.  The deviations of
    both steps are added in squares.
    """
    p, n = 1 - percent / 100, BITS
    flips = 2 * FOLDED * p
    once, twice = (1 - 2 / n) ** flips, (1 - 4 / n) ** flips
    variance = n / 4 * (1 - twice) + n * n / 4 * (twice - once * once)
    return math.ceil(n / 2 * (1 - once) + sigmas * math.sqrt((2 * once) ** 2 * FOLDED * p * (1 - p) + max(0.0, variance)))


def shingle_sets(text: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order."""
    found = Words(*text_bytes(text), SPACED, lower=True)
    sums = word_run_sums(found.hashes())
    counts = found.counts()
    size = np.minimum(counts, words)
    windows = np.where(counts > 0, counts - size + 1, 0)
    at = np.concatenate([np.arange(a, a + n) for a, n in zip(found.first[:-1], windows, strict=True)]
                        or [np.zeros(0, np.int64)]).astype(np.int64)
    hashes = word_run_hash(sums, at, np.repeat(size, windows))
    ends = np.cumsum(windows)
    return [np.unique(hashes[e - n:e]) for e, n in zip(ends, windows, strict=True)]


def _min_hashes(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """The first ``samples`` minima of each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), samples), np.uint64)
    for i in range(samples):
        out[:, i] = np.minimum.reduceat(flat * _SLOPE[i] + _SHIFT[i], starts)
    return out


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    minima, bands = _min_hashes(sets, SAMPLES), np.zeros((len(sets), BANDS), np.uint64)
    for i in range(ROWS):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + mix(minima[:, i::ROWS]) + np.arange(BANDS, dtype=np.uint64))
    return bands.view(np.int64)


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps of FOLDED minima, as 64-bit words."""
    sample = mix(_min_hashes(sets, FOLDED) + np.arange(FOLDED, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    place = (sample % np.uint64(BITS)).astype(np.int64) + BITS * np.arange(len(sets))[:, None]
    bits = np.bincount(place.reshape(-1), minlength=BITS * len(sets)).reshape(-1, BITS) & 1
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


def _lists(some: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.where(some, values.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


SKETCHED = "doc_id long, near_text long, near_n long, near_set binary, near_bands array<long>"


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in row_slices(batch.column(2)):
                part = batch.slice(lo, n)
                sets = shingle_sets(part.column(2), words)
                filled = [s for s in sets if len(s)]
                some = np.array([len(s) > 0 for s in sets])
                bands = _bands(filled) if filled else np.zeros((0, BANDS), np.int64)
                digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digests, pa.binary()), _lists(some, bands)],
                    ["doc_id", "near_text", "near_n", "near_set", "near_bands"])
    return run


def sketch_documents(docs: DataFrame, words: int) -> DataFrame:
    """Per document: id, hash of the text, set size, digest of the set and band hashes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("near_text"), "text") \
        .mapInArrow(_sketch(words), SKETCHED)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            on = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on)], ["u", "v"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in row_slices(batch.column(1)):
                part = batch.slice(lo, n)
                sets = shingle_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                     _lists(np.ones(n, bool), odd_sketches(sets))], ["node", "size", "shingles", "odd"])
    return run


def _full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``node, size, shingles, odd`` of the given classes, each from one of its texts."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("near_least"),
                      F.xxhash64("text").alias("near_text"), "text")
    sets = stage_table(own.join(classes.select("node", "near_least", "near_text"), ["near_least", "near_text"])
                       .select("node", "text").mapInArrow(_sets(words), "node long, size long, shingles binary, odd array<long>"),
                       "near-sets")
    return stage_table(sets.dropDuplicates(["node"]), "near-sets") if _repeated(sets) else sets


def _similar(percent: int) -> Column:
    """The test on sizes and sketches, whose words are columns of their own: over arrays, the generated code of the
    join is too long for the JVM to compile."""
    sizes = 100 * F.least("size_u", "size_v") >= percent * F.greatest("size_u", "size_v")
    odd = sum((F.bit_count(F.col(f"odd_u{i}").bitwiseXOR(F.col(f"odd_v{i}"))) for i in range(BITS // 64)), F.lit(0))
    return sizes & (odd <= odd_limit(percent))


def _sketch_columns(sets: DataFrame, x: str) -> DataFrame:
    return sets.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"),
                       *[F.coalesce(F.get("odd", F.lit(i)), F.lit(0)).alias(f"odd_{x}{i}") for i in range(BITS // 64)])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets reach the threshold."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    return stage_table(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "set_u", "set_v")
                       .mapInArrow(_confirm(percent), "u long, v long"), "near-links")


_LAST = (1 << 63) - 1


def _repeated(sets: DataFrame) -> bool:
    """Whether a text came twice, as it does when a row of the input is repeated."""
    return bool(sets.groupBy("node").count().where("count > 1").take(1))


def near_classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: ``doc_id, near_text, near_n``, ``near_component`` (the smallest id reachable) and ``near_first`` (of the
    texts with that id in the component, the least hash)."""
    rows = stage_table(sketch_documents(docs, words), "near-rows")
    least = F.coalesce("doc_id", F.lit(_LAST))
    classes = stage_table(
        rows.where("near_n > 0").groupBy("near_set").agg(
            F.min(F.struct(least.alias("id"), "near_text")).alias("least"), F.any_value("near_bands").alias("near_bands"))
        .select(F.monotonically_increasing_id().alias("node"), "near_set", F.col("least.id").alias("near_least"),
                F.col("least.near_text").alias("near_text"), "near_bands"), "near-classes")

    places = classes.select("node", "near_least", F.posexplode("near_bands").alias("band", "bucket"))
    buckets = places.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
    places = stage_table(places.join(buckets, "bucket"), "near-places")
    popular = places.groupBy("node").agg(F.sum("held").alias("near"))
    sets = _full_sets(docs, classes.join(popular, "node"), words)
    sketch = lambda x: _sketch_columns(sets, x)

    centres = places.join(popular, "node").groupBy("bucket").agg(
        F.max_by("node", F.struct("near", "node")).alias("popular"), F.min_by("node", F.struct("near_least", "node")).alias("least"))
    star = places.join(centres, "bucket").select("node", F.explode(F.array("popular", "least")).alias("other")).where("node <> other")
    tested = stage_table(star.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct(),
                         "near-star", small=True)
    links = _links(tested.join(sketch("u"), "u").join(sketch("v"), "v").where(_similar(percent)).select("u", "v"), sets, percent)
    labels = stage_table(components(links), "near-labels", small=True)

    known = places.select("bucket", "band", "node").join(labels, "node", "left").select(
        "bucket", "band", "node", F.coalesce("label", "node").alias("label"))
    mixed = known.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("bucket")
    known = stage_table(known.join(mixed, "bucket"), "near-mixed", small=True)
    main = (known.groupBy("bucket", "label").count().groupBy("bucket")
            .agg(F.max_by("label", F.struct("count", "label")).alias("main")))
    known = known.join(main, "bucket")
    bands = lambda x: classes.select(F.col("node").alias(x), F.col("near_bands").alias(f"bands_{x}"))
    inside = (known.select("bucket", F.col("node").alias("v"), F.col("label").alias("label_v"))
              .join(sketch("v"), "v").join(bands("v"), "v"))
    outside = (known.where("label <> main").select(
        F.col("bucket").alias("own"), "band", F.col("node").alias("u"), F.col("label").alias("label_u"), "main")
        .join(sketch("u"), "u").join(bands("u"), "u"))
    # A pair counts in the first bucket that it shares; band hashes differ between bands.
    first = ~F.arrays_overlap(F.slice("bands_u", F.lit(1), F.col("band")), F.slice("bands_v", F.lit(1), F.col("band")))
    pairs = (outside.join(inside, (F.col("own") == F.col("bucket")) & (F.col("label_u") != F.col("label_v"))
                          & ((F.col("u") < F.col("v")) | (F.col("label_v") == F.col("main"))) & _similar(percent) & first)
             .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
             .join(tested, ["u", "v"], "left_anti"))
    more = _links(stage_table(pairs, "near-rest", small=True), sets, percent)
    if more.take(1):
        labels = components(links.unionByName(more))

    member = stage_table(classes.select("node", "near_set", "near_least", "near_text").join(labels, "node", "left")
                         .select("near_set", "near_least", "near_text", F.coalesce("label", "node").alias("label")),
                         "near-members", small=True)
    smallest = member.groupBy("label").agg(F.min(F.struct("near_least", "near_text")).alias("least"))
    member = member.join(smallest, "label").select(
        "near_set", F.col("least.near_least").alias("near_component"), F.col("least.near_text").alias("near_first"))
    return rows.select("doc_id", "near_text", "near_n", "near_set").join(member, "near_set", "left").select(
        "doc_id", "near_text", "near_n",
        F.when(F.col("near_n") == 0, F.col("doc_id")).otherwise(F.nullif("near_component", F.lit(_LAST))).alias("near_component"),
        F.coalesce("near_first", "near_text").alias("near_first"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept`` (its id is the component's)."""
    rows = near_classes(docs, words, percent)
    return rows.select("doc_id", F.col("near_n").alias("n_shingles"), F.col("near_component").alias("component_id"),
                       F.col("doc_id").eqNullSafe(F.col("near_component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, and every document without words."""
    keep = near_classes(docs, words, percent).where(F.col("doc_id").eqNullSafe(F.col("near_component"))
                                                    & (F.col("near_text") == F.col("near_first")))
    keep = keep.select(F.coalesce("doc_id", F.lit(_LAST)).alias("near_id"), "near_text",
                       (F.col("near_n") > 0).alias("near_filled")).distinct()
    own = (docs.withColumn("near_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
           .withColumn("near_text", F.xxhash64("text")))
    same = W.partitionBy("near_id", "near_text").orderBy("near_id")
    return (own.join(keep, ["near_id", "near_text"]).withColumn("near_copy", F.row_number().over(same))
            .where("near_copy = 1 OR NOT near_filled").select(*docs.columns))
