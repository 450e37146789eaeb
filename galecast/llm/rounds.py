"""Two rounds of a packed exchange, shared by the two substring operators.

Documents are put into groups of a few MB of text by a hash of id and text.
Round one sends the groups' anchors to buckets by their hash, which answer each
group with those anchors that documents with different ids share.  Round two
sends what surrounds the shared anchors to buckets, which answer with the
smallest id that has it.  The groups then finish alone.

A group sends each anchor once, with the least and greatest id in the group:
a passage that a third of all documents share costs its bucket one entry per
group, not per document.  Ids travel as arrays of numbers, not as rows.  The
text is shuffled once: the three passes over the groups ask for the same
exchange, which Spark reuses.  Groups and buckets grow in number with the
input, so that no task's memory does.

Texts that equal a whole text of a smaller id have nothing of their own: they
are found first, by a digest, and take no part in the rounds.

A null id counts as the greatest id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage_table

GROUP_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20
NO_ID = np.iinfo(np.int64).max


def pack(values: np.ndarray) -> bytes:
    """Non-negative ids take four bytes each where that is enough."""
    if len(values) and (values.min() < 0 or values.max() >= 1 << 32):
        return values.astype(np.int64).tobytes()
    return values.astype(np.uint32).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int64 if len(data) == 8 * n else np.uint32).astype(np.int64)


def group_ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()


def least_and_greatest(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the least ``low`` and greatest ``high`` of each."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(at):
        return keys, low, high
    return keys[at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)


def by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """``(bucket, from, to)`` of sorted keys; buckets are ranges of the key's upper half."""
    if not len(keys):
        return []
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)], strict=True))


def find(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in sorted ``known``, and where."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def column_bytes(table: pa.Table, name: str) -> list[bytes]:
    return table.column(name).to_pylist()


def shared_anchors(group: pa.Table, name: str = "keys") -> np.ndarray:
    """All anchors a group was answered with, in order."""
    parts = [np.frombuffer(x, np.uint64) for x in column_bytes(group, name) if x is not None]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def greatest(low: np.ndarray, high: np.ndarray) -> bytes:
    """Where and what ``high`` is, where it isn't ``low``."""
    at = np.flatnonzero(low != high)
    return at.astype(np.uint32).tobytes() + high[at].astype(np.int64).tobytes()


def with_greatest(low: np.ndarray, data: bytes) -> np.ndarray:
    n, out = len(data) // 12, low.copy()
    out[np.frombuffer(data, np.uint32, n)] = np.frombuffer(data, np.uint8, offset=4 * n).view(np.int64)
    return out


def is_copy(group: pa.Table, answers: pa.Table) -> np.ndarray:
    """Which rows of a group equal a text with a smaller id."""
    known = {d: k for d, k in zip(answers.column("digest").to_pylist(), answers.column("original").to_pylist(), strict=True)
             if d is not None}
    if not known:
        return np.zeros(len(group), bool)
    return np.array([known.get(d, NO_ID) < k for d, k in zip(group.column("digest").to_pylist(), group_ids(group), strict=True)], bool)


SENT = "bucket long, grp long, keys binary, low binary, high binary, several binary"
ANSWER = "grp long, keys binary, hot binary"


def send_entries(grp: int, keys: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int,
                 pieces: np.ndarray | None = None) -> pa.Table:
    """``pieces``: what the group will send for each key in round two, where that can be more than one."""
    pieces = np.ones(len(keys), np.int64) if pieces is None else pieces
    rows = [(b, grp, keys[i:j].tobytes(), pack(low[i:j]), greatest(low[i:j], high[i:j]), _several(pieces[i:j]))
            for b, i, j in by_bucket(keys, buckets)]
    names = ["bucket", "grp", "keys", "low", "high", "several"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({x: pa.array([r[k] for r in rows], kinds[k]) for k, x in enumerate(names)})


def _several(pieces: np.ndarray) -> bytes:
    """Where and how many, where there are more than one."""
    at = np.flatnonzero(pieces > 1)
    return at.astype(np.uint32).tobytes() + pieces[at].astype(np.uint32).tobytes()


def _pieces(several: list[bytes], n: np.ndarray) -> np.ndarray:
    out = np.ones(int(n.sum()), np.int64)
    for data, lo in zip(several, np.cumsum(n) - n, strict=True):
        at, more = np.frombuffer(data, np.uint32).reshape(2, -1)
        out[lo + at] = more
    return out


def read_entries(bucket: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``keys, low, high`` of all groups on end, the row of each, and each row's group."""
    blobs = column_bytes(bucket, "keys")
    n = np.array([len(x) // 8 for x in blobs], dtype=np.int64)
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in blobs])
    low = [unpack(x, k) for x, k in zip(column_bytes(bucket, "low"), n, strict=True)]
    high = np.concatenate([with_greatest(x, y) for x, y in zip(low, column_bytes(bucket, "high"), strict=True)])
    low = np.concatenate(low)
    return keys, low, high, np.repeat(np.arange(len(n)), n), bucket.column("grp").to_numpy()


def answer_shared(bucket: pa.Table, most: int | None = None) -> pa.Table:
    """To each group, its keys that documents with different ids have; hot are those with over ``most`` pieces in all groups."""
    keys, low, high, row, grp = read_entries(bucket)
    own, least, greatest = least_and_greatest(keys, low, high)
    shared, _ = find(keys, own[least < greatest])
    hot = np.zeros(len(keys), bool)
    if most is not None:
        place = np.searchsorted(own, keys)
        total = np.bincount(place, _pieces(column_bytes(bucket, "several"), np.bincount(row, minlength=len(grp))), minlength=len(own))
        hot = shared & (total[place] > most)
    out = [(int(grp[r]), keys[i:j][shared[i:j]].tobytes(), keys[i:j][hot[i:j]].tobytes()) for r, i, j in row_runs(row)
           if shared[i:j].any()]
    return pa.table({"grp": pa.array([x[0] for x in out], pa.int64()), "keys": pa.array([x[1] for x in out], pa.binary()),
                     "hot": pa.array([x[2] for x in out], pa.binary())})


def row_runs(row: np.ndarray) -> list[tuple[int, int, int]]:
    """``(row, from, to)`` of the runs of equal numbers."""
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    return list(zip(row[at].tolist(), at.tolist(), [*at[1:].tolist(), len(row)], strict=True))


def two_rounds(docs: DataFrame, anchors: Callable, surroundings: Callable, decide: Callable, finish: Callable,
               sent: str, answer: str, result: str, group_bytes: int = GROUP_BYTES, most: int | None = None) -> DataFrame:
    """``anchors(group, copies, buckets)``, ``surroundings(group, shared, buckets)``, ``decide(bucket)`` and
    ``finish(group, answers)`` get and return Arrow tables.  Anchors with over ``most`` pieces are told as hot."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.md5("text").alias("digest"), F.xxhash64("doc_id", "text").alias("spread"))
    narrow = stage_table(rows.select("doc_id", "digest", "spread", F.octet_length("text").alias("bytes")), "rounds")
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, buckets = max(2 * parts, -(-total // group_bytes)), max(parts, -(-total // BUCKET_BYTES))
    grp = F.pmod("spread", F.lit(n)).cast("long").alias("grp")

    known = F.coalesce("doc_id", F.lit(int(NO_ID)))
    first = (narrow.where("bytes > 0").groupBy("digest").agg(F.min(known).alias("original"), F.max(known).alias("last"))
             .where("original < last").drop("last"))
    copies = stage_table(narrow.join(first, "digest").where(known > F.col("original"))
                         .select(grp, "digest", "original").distinct(), "rounds-copies", small=True)

    def with_copies(answers: DataFrame) -> DataFrame:
        return answers.unionByName(copies, allowMissingColumns=True)

    groups = rows.select("doc_id", "text", "digest", grp)
    cogrouped = lambda other, f, schema: groups.groupBy("grp").cogroup(other.groupBy("grp")).applyInArrow(f, schema)
    entries = cogrouped(copies, lambda t, s: anchors(t, s, buckets), SENT)
    shared = entries.groupBy("bucket").applyInArrow(lambda t: answer_shared(t, most), ANSWER)
    around = cogrouped(with_copies(shared), lambda t, s: surroundings(t, s, buckets), sent)
    found = around.groupBy("bucket").applyInArrow(decide, answer)
    return cogrouped(with_copies(found), finish, result)
