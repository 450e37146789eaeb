"""Removal of repeated runs of words by difference-cover anchors.

A word goes when a run of ``WINDOW`` consecutive words that covers it also
starts in a document with a smaller id.  Only runs of ``ANCHOR`` words that
begin at a position in ``COVER`` modulo ``PERIOD`` are hashed first.  COVER is
a perfect difference set: every residue is a difference of two of its members,
so for any two positions a shift below PERIOD takes both into it, and two equal
windows of ``WINDOW = ANCHOR + PERIOD - 1`` words hold an equal anchor at the
same distance from their starts, wherever they begin.

Anchors that documents with different ids share are then extended: every
window that holds one is hashed whole and gets the smallest id that has it (see
``rounds`` for the exchange).  Runs are told apart by 64-bit hashes.

Defined results.  Null or empty text: no words, nothing removed, empty kept
text.  A null id counts as greater than every other; rows with the same id
never remove from each other.  Repeated rows get equal results.  Other columns
are dropped, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .kernels import SPACED, Words, covered, ragged, row_slices, sums_by, text_bytes, word_run_hash, word_run_sums
from .rounds import GROUP_BYTES, SENT, column_bytes, find, group_ids, is_copy, least_and_greatest, pack, read_entries, \
    row_runs, send_entries, shared_anchors, two_rounds, unpack

WINDOW = 50
#: A perfect difference set modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _slices(group: pa.Table, copies: np.ndarray):
    """``words, ids, copies`` of bounded slices of a group."""
    table = group.combine_chunks()
    text, ids = table.column("text").chunk(0) if len(table) else pa.array([], pa.string()), group_ids(table)
    for lo, n in row_slices(text):
        buf, offsets = text_bytes(text.slice(lo, n))
        yield Words(buf, offsets, SPACED, lower=False), ids[lo:lo + n], copies[lo:lo + n]


def _originals(group: pa.Table, answers: pa.Table):
    """``words, ids`` of the texts that are no copies."""
    group = group.filter(pa.array(~is_copy(group, answers)))
    for words, ids, _ in _slices(group, np.zeros(len(group), bool)):
        yield words, ids


def _anchor_hashes(words: Words, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, texts and hashes of the anchors."""
    at, of = words.windows(ANCHOR)
    on = _IN_COVER[(at - words.first[of]) % PERIOD]
    at, of = at[on], of[on]
    return at, of, word_run_hash(sums, at, ANCHOR)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], grp: int, buckets: int) -> pa.Table:
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
    ids = np.concatenate([i for _, i in parts]) if parts else np.zeros(0, np.int64)
    return send_entries(grp, *least_and_greatest(keys, ids, ids), buckets)


def _anchors(group: pa.Table, copies: pa.Table, buckets: int) -> pa.Table:
    parts = []
    for words, ids in _originals(group, copies):
        _, of, hashes = _anchor_hashes(words, word_run_sums(words.hashes()))
        parts.append((hashes, ids[of]))
    return _merged(parts, _number(group), buckets)


def _number(group: pa.Table) -> int:
    return group.column("grp")[0].as_py() if len(group) else -1


def _extended(group: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    shared, parts = shared_anchors(answers), []
    for words, ids in _originals(group, answers) if len(shared) else ():
        sums = word_run_sums(words.hashes())
        at, _, hashes = _anchor_hashes(words, sums)
        at = at[find(hashes, shared)[0]]
        holds = covered(len(words), np.maximum(at - PERIOD + 1, 0), at + 1)
        start, of = words.windows(WINDOW)
        on = holds[start]
        parts.append((word_run_hash(sums, start[on], WINDOW), ids[of[on]]))
    return _merged(parts, _number(group), buckets)


def _smallest(bucket: pa.Table) -> pa.Table:
    """To each group, those of its windows that a document with a smaller id has, and the smallest such id."""
    keys, low, high, row, grp = read_entries(bucket)
    own, least, _ = least_and_greatest(keys, low, high)
    least = least[np.searchsorted(own, keys)]
    out = [(int(grp[r]), keys[i:j][on].tobytes(), pack(least[i:j][on])) for r, i, j in row_runs(row)
           if (on := least[i:j] < high[i:j]).any()]
    return pa.table({"grp": pa.array([x[0] for x in out], pa.int64()), "keys": pa.array([x[1] for x in out], pa.binary()),
                     "least": pa.array([x[2] for x in out], pa.binary())})


def _kept_text(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    at = np.flatnonzero(keep)
    of = np.searchsorted(words.first, at, "right") - 1
    length = words.end[at] - words.start[at]
    last = np.concatenate([of[1:] != of[:-1], [True]]) if len(at) else np.zeros(0, bool)
    size = length + ~last
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(at) else 0, 0x20, np.uint8)
    source, own = ragged(words.start[at], length)
    out[source + ((ends - size) - words.start[at])[own]] = words.norm[source]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, weights=size, minlength=len(words.first) - 1))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def _finish(group: pa.Table, answers: pa.Table) -> pa.Table:
    copies = is_copy(group, answers)
    answers = answers.filter(pa.compute.is_valid(answers.column("keys")))
    blobs = column_bytes(answers, "keys")
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in blobs]) if blobs else np.zeros(0, np.uint64)
    least = np.concatenate([unpack(y, len(x) // 8) for x, y in zip(blobs, column_bytes(answers, "least"), strict=True)]) \
        if blobs else np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys, least = keys[order], least[order]
    n_words, n_removed, kept = [], [], []
    for words, ids, copy in _slices(group, copies):
        gone = np.repeat(copy & (words.counts() >= WINDOW), words.counts())
        if len(keys):
            start, of = words.windows(WINDOW)
            known, at = find(word_run_hash(word_run_sums(words.hashes()), start, WINDOW), keys)
            known[known] = least[at[known]] < ids[of[known]]
            gone |= covered(len(words), start[known], start[known] + WINDOW)
        n_words.append(words.counts())
        n_removed.append(sums_by(words.first, gone))
        kept.append(_kept_text(words, ~gone))
    flat = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64), pa.int64())
    return pa.table({"doc_id": group.column("doc_id"), "n_words": flat(n_words), "n_removed": flat(n_removed),
                     "kept": pa.chunked_array(kept, pa.string())})


def remove_repeated_words(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept`` (the kept words, joined by one space)."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return two_rounds(docs, _anchors, _extended, _smallest, _finish, SENT, "grp long, keys binary, least binary",
                      "doc_id long, n_words long, n_removed long, kept string", group_bytes)
