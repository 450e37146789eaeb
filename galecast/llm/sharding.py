"""Sharding by histogram sort.

Rows are ordered by a composite key of three 60-bit numbers: a hash of the
text (equal texts are neighbours and land in as few shards as their bytes
need), a hash of the id, and the row's running number, which only matters
among rows equal in both.  Splitters are found by counting, not by sorting:
each round counts the exact bytes and rows under 4096 probes inside every
interval that still holds a splitter (a plain partial aggregate over all
partitions), keeps the probe interval that holds the splitter's target, and
ends when an edge is within the tolerance.  A text that holds a third of all
bytes is split by the later parts of the key.  Then one exchange brings each
range together and numbers its rows.

Only counts come to the driver: at most 4096 per open splitter and round.

Defined results.  Null text counts no bytes but the row's overhead and is
ordered like an empty text hash of its own; null ids hash to one value.  An
empty table has no splitters and gives an empty result.  Repeated rows are
separate rows.  Other columns are kept and may have any name but those that
begin with ``shard_``.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stage_table

DIGIT, PER_KEY, KEYS = 12, 5, ("shard_k", "shard_t", "shard_m")
BITS = DIGIT * PER_KEY
OVERHEAD = 16


@dataclass(frozen=True)
class Splitters:
    """Lower bounds, as composite numbers, of ranges 1, 2, ...; ``per_shard`` ranges make a shard."""

    bounds: tuple[int, ...]
    shards: int
    per_shard: int


def doc_bytes(text: Column, overhead: int = OVERHEAD) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def with_keys(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """Add the three key parts and ``shard_size``."""
    return (docs.withColumn("shard_k", F.shiftrightunsigned(F.xxhash64("text"), 64 - BITS))
            .withColumn("shard_t", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS))
            .withColumn("shard_m", F.monotonically_increasing_id())
            .withColumn("shard_size", doc_bytes(F.col("text"), overhead)))


def _digit(level: int) -> Column:
    key, at = divmod(level, PER_KEY)
    return F.shiftrightunsigned(F.col(KEYS[key]), BITS - DIGIT * (at + 1)).bitwiseAND(2 ** DIGIT - 1)


def _prefix(level: int) -> list[Column]:
    """The key cut to its first ``level`` digits, as whole parts and a shifted one."""
    key, at = divmod(level, PER_KEY)
    parts = [F.col(k) for k in KEYS[:key]]
    return parts + ([F.shiftrightunsigned(F.col(KEYS[key]), BITS - DIGIT * at)] if at else [])


def find_splitters(rows: DataFrame, shards: int, per_shard: int = 1, tolerance: float = 0.001) -> Splitters:
    """Splitters of ``shards * per_shard`` ranges of near equal ``shard_size`` sums.

    ``tolerance`` is the allowed distance of a splitter from its target as a
    share of a range.
    """
    n = shards * per_shard
    bounds: list[int | None] = [None] * (n - 1)
    open_at: dict[int, tuple[tuple[int, ...], int, int]] = {}  # splitter -> prefix digits, bytes below it
    total = targets = None
    for level in range(PER_KEY * len(KEYS)):
        names = [f"p{i}" for i in range(len(_prefix(level)))]
        part = rows.select(*[c.alias(x) for c, x in zip(_prefix(level), names, strict=True)],
                           _digit(level).cast("int").alias("d"), "shard_size")
        if level:
            kept = sorted({tuple(p) for p, _ in open_at.values()})
            known = json.dumps([dict(zip(names, _parts(p), strict=True)) for p in kept])
            kind = ",".join(f"{x}:bigint" for x in names)
            wanted = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(known), f"array<struct<{kind}>>")))
            part = part.join(F.broadcast(wanted), names)  # a row per open splitter at most
        counts: dict[tuple[int, ...], dict[int, int]] = {}
        for r in part.groupBy(*names, "d").agg(F.sum("shard_size").alias("b")).collect():
            counts.setdefault(tuple(r[:-2]), {})[r["d"]] = r["b"]
        if total is None:
            total = sum(counts.get((), {}).values())
            if not total:
                return Splitters((), shards, per_shard)
            targets = [total * (s + 1) / n for s in range(n - 1)]
            open_at = {s: ((), 0) for s in range(n - 1)}
        slack, still = tolerance * total / n, {}
        for s, (prefix, below) in open_at.items():
            for d, here in sorted(counts[tuple(_parts(prefix))].items()):
                if below + here >= targets[s]:
                    break
                below += here
            low, high = targets[s] - below, below + here - targets[s]
            child = (*prefix, d)
            if min(low, high) <= slack or level == PER_KEY * len(KEYS) - 1:
                bounds[s] = _number(child) + (0 if low <= high else 1 << (BITS * len(KEYS) - DIGIT * len(child)))
            else:
                still[s] = (child, below)
        open_at = still
        if not open_at:
            break
    return Splitters(tuple(bounds), shards, per_shard)


def _number(digits: tuple[int, ...]) -> int:
    out = 0
    for d in digits:
        out = out << DIGIT | d
    return out << (BITS * len(KEYS) - DIGIT * len(digits))


def _parts(digits: tuple[int, ...]) -> list[int]:
    out = []
    for i in range(0, len(digits), PER_KEY):
        value = 0
        for d in digits[i:i + PER_KEY]:
            value = value << DIGIT | d
        out.append(value)
    return out


def _range_of(found: Splitters) -> Column:
    """How many bounds a row's key has reached; a row compares only with bounds that begin with its first digit."""
    mask = 2 ** BITS - 1
    bounds = [[b >> 2 * BITS, b >> BITS & mask, b & mask] for b in found.bounds]
    first = [min(b[0] >> (BITS - DIGIT), 2 ** DIGIT) for b in bounds]
    start = [sum(f < d for f in first) for d in range(2 ** DIGIT)] if len(first) < 64 else _starts(first)
    held = [0] * 2 ** DIGIT
    for f in first:
        if f < 2 ** DIGIT:
            held[f] += 1
    digit = F.shiftrightunsigned(F.col("shard_k"), BITS - DIGIT).cast("int") + 1
    at = lambda xs: F.element_at(F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>"), digit)
    known = F.from_json(F.lit(json.dumps([{"k": k, "t": t, "m": m} for k, t, m in bounds])),
                        "array<struct<k:bigint,t:bigint,m:bigint>>")
    own = F.struct(F.col("shard_k").alias("k"), F.col("shard_t").alias("t"), F.col("shard_m").alias("m"))
    return at(start) + F.when(at(held) > 0, F.size(F.filter(F.slice(known, at(start) + 1, F.greatest(at(held), F.lit(1))),
                                                            lambda b: b <= own))).otherwise(0)


def _starts(first: list[int]) -> list[int]:
    from bisect import bisect_left
    return [bisect_left(first, d) for d in range(2 ** DIGIT)]


def place(rows: DataFrame, found: Splitters) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in the order of the key): the one exchange."""
    if not found.bounds:
        reach = F.lit(0)
    else:
        reach = _range_of(found)
    out = rows.withColumn("shard_range", reach.cast("int"))
    order = W.partitionBy("shard_range").orderBy(*KEYS)
    if found.per_shard == 1:
        return out.withColumn("shard", F.col("shard_range")).withColumn("slot", (F.row_number().over(order) - 1).cast("long"))
    runs = out.groupBy("shard_range").agg(F.count("*").alias("shard_rows"))
    before = W.partitionBy((F.col("shard_range") / found.per_shard).cast("int")).orderBy("shard_range").rowsBetween(
        W.unboundedPreceding, -1)
    runs = runs.select("shard_range", F.coalesce(F.sum("shard_rows").over(before), F.lit(0)).alias("shard_before"))
    return (out.withColumn("slot", F.row_number().over(order).cast("long") - 1).join(runs, "shard_range")
            .withColumn("slot", F.col("slot") + F.col("shard_before"))
            .withColumn("shard", (F.col("shard_range") / found.per_shard).cast("int")).drop("shard_before"))


def shard_documents(docs: DataFrame, shards: int = 40, rows_per_range: int = 1_000_000,
                    tolerance: float = 0.001, overhead: int = OVERHEAD) -> DataFrame:
    """``docs``' own columns plus ``shard`` and ``slot``, sizes near equal by bytes.

    The keys are staged as a narrow table first, so the rounds never read the
    text.  ``rows_per_range`` bounds what one task has to order.
    """
    keyed = with_keys(docs, overhead)
    narrow = stage_table(keyed.select(*KEYS, "shard_size"), "shard")
    found = find_splitters(narrow, shards, _per_shard(narrow, shards, rows_per_range), tolerance)
    return place(keyed, found).select(*docs.columns, "shard", "slot")


def _per_shard(rows: DataFrame, shards: int, rows_per_range: int) -> int:
    return max(1, math.ceil(rows.count() / (shards * rows_per_range)))


def shard_digest(docs: DataFrame, shards: int = 40, rows_per_range: int = 1_000_000,
                 tolerance: float = 0.001, overhead: int = OVERHEAD) -> DataFrame:
    """Where each document goes, without its text: ``doc_id, size, text_crc32, shard, slot``."""
    narrow = stage_table(
        with_keys(docs, overhead).withColumn("shard_crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
        .select("doc_id", *KEYS, "shard_size", "shard_crc"), "shard")
    found = find_splitters(narrow, shards, _per_shard(narrow, shards, rows_per_range), tolerance)
    return place(narrow, found).select("doc_id", F.col("shard_size").alias("size"),
                                       F.col("shard_crc").alias("text_crc32"), "shard", "slot")
