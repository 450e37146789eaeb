"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id.

Which suffixes have to meet: every window of LENGTH bytes belongs to the least
hash of the ``GRAM``-byte strings in it, so equal windows belong to the same
one wherever they are.  Consecutive windows with one least hash form a segment
of the text.  Round one of the exchange (see ``rounds``) finds the hashes that
documents with different ids share, round two brings the segments that belong
to them together, each distinct segment of a group of documents once.  A hash
with more than ``HOT`` distinct segments over all groups, as at the borders of a
phrase that millions of documents have in differing surroundings, sends single
windows instead, each to the bucket of its own hash: equal windows still meet, and
no bucket or transform gets all that surrounds the phrase.

What repeats is then decided on the segments alone.  Their suffixes are sorted
and the intervals of suffixes with a common prefix are expanded breadth first:
level by level every interval is extended backward by the character in front
of its suffixes, which yields the intervals one byte deeper and so the common
prefixes by increasing value, until LENGTH is reached.  Rows that have fallen
apart earlier take no part in later levels.  An interval at that depth holds
all places of one window, and the smallest id among them goes back to the
documents.

Defined results.  Null or empty text: no bytes, nothing removed.  A null id
counts as greater than every other; rows with the same id never remove from
each other.  Repeated rows get equal results.  Kept bytes are binary, as cuts
may fall inside a character.  Other columns are dropped, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .kernels import byte_run_hash, byte_run_sums, covered, gram_hashes, ragged, row_slices, runs, sums_by, text_bytes
from .rounds import BUCKET_BYTES, GROUP_BYTES, by_bucket, column_bytes, find, greatest, group_ids, is_copy, least_and_greatest, pack, \
    row_runs, send_entries, shared_anchors, two_rounds, unpack, with_greatest

LENGTH = 50
GRAM = 24
#: Windows in a segment at most, and bytes of segments in one transform (unless one hash alone has more).
SEGMENT, TRANSFORM_BYTES = 32, 1 << 19
#: Segments of one hash that meet in one bucket, at most: as many bytes as a bucket should have.
HOT = BUCKET_BYTES // (SEGMENT + LENGTH - 1)
SENT = "bucket long, grp long, anchors binary, keys binary, low binary, high binary, sizes binary, data binary"
ANSWER = "grp long, keys binary, counts binary, least binary, alone binary"


class Segments:
    """The segments of consecutive texts: first window, number of windows, least hash, content hash and text of each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        windows = np.maximum(0, np.diff(offsets) - LENGTH + 1)
        self.sums = byte_run_sums(buf)
        low, width, span = gram_hashes(self.sums, GRAM), 1, LENGTH - GRAM + 1
        while width < span:  # least of `width` neighbours, doubled until all of a window are in
            step = min(width, span - width)
            low, width = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0], width + step
        valid = covered(len(buf), offsets[:-1], offsets[:-1] + windows)
        new = valid.copy()
        new[1:len(low)] &= low[1:] != low[:-1]
        new[offsets[:-1][windows > 0]] = True
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(buf)]])
        of = np.searchsorted(offsets, first, "right") - 1
        count = np.minimum(last, offsets[of] + windows[of]) - first
        pieces = -(-count // SEGMENT)
        piece, own = ragged(np.zeros(len(first), np.int64), pieces)
        self.first = first[own] + piece * SEGMENT
        self.count = np.minimum(SEGMENT, count[own] - piece * SEGMENT)
        self.anchor, self.text = low[self.first], of[own]

    def keys(self) -> np.ndarray:
        return byte_run_hash(self.sums, self.first, self.count + LENGTH - 1)

    def windows(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows at the given places; that of a segment of one window is its key."""
        return byte_run_hash(self.sums, at, LENGTH)


def _slices(group: pa.Table, copies: np.ndarray):
    """``bytes, offsets, ids, copies`` of bounded slices of a group."""
    table = group.combine_chunks()
    text, ids = table.column("text").chunk(0) if len(table) else pa.array([], pa.string()), group_ids(table)
    for lo, n in row_slices(text):
        yield *text_bytes(text.slice(lo, n)), ids[lo:lo + n], copies[lo:lo + n]


def _originals(group: pa.Table, answers: pa.Table):
    """``bytes, offsets, ids`` of the texts that are no copies."""
    group = group.filter(pa.array(~is_copy(group, answers)))
    for buf, offsets, ids, _ in _slices(group, np.zeros(len(group), bool)):
        yield buf, offsets, ids


def _anchors(group: pa.Table, copies: pa.Table, buckets: int) -> pa.Table:
    keys, contents, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for buf, offsets, own in _originals(group, copies):
        found = Segments(buf, offsets)
        keys.append(found.anchor)
        contents.append(found.keys())
        ids.append(own[found.text])
    keys, contents, ids = np.concatenate(keys), np.concatenate(contents), np.concatenate(ids)
    own, low, high = least_and_greatest(keys, ids, ids)
    first = np.unique(contents, return_index=True)[1]
    pieces = np.bincount(np.searchsorted(own, keys[first]), minlength=len(own))
    return send_entries(group.column("grp")[0].as_py() if len(group) else -1, own, low, high, buckets, pieces)


def _segments(group: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Each distinct segment at a shared hash once, with its bytes; at a hot one each distinct window, under its own hash."""
    shared, hot, rows = shared_anchors(answers), shared_anchors(answers, "hot"), []
    known: dict[str, list[np.ndarray]] = {x: [] for x in ("anchor", "key", "id", "size", "data")}
    for buf, offsets, ids in _originals(group, answers) if len(shared) else ():
        found = Segments(buf, offsets)
        alone = find(found.anchor, hot)[0]
        on = np.flatnonzero(find(found.anchor, shared)[0] & ~alone)
        window, of = ragged(found.first[alone], found.count[alone])
        windows = found.windows(window)
        for anchor, key, text, first, size in (
                (found.anchor[on], found.keys()[on], found.text[on], found.first[on], found.count[on] + LENGTH - 1),
                (windows, windows, found.text[alone][of], window, np.full(len(window), LENGTH))):
            own = ids[text]
            order = np.lexsort((own, key))  # the least and the greatest id of equal content stay
            starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else order
            kept = np.unique(np.concatenate([order[starts], order[np.append(starts[1:], len(key)) - 1]])) if len(key) else order
            place, _ = ragged(first[kept], size[kept])
            for name, x in (("anchor", anchor[kept]), ("key", key[kept]), ("id", own[kept]), ("size", size[kept]),
                            ("data", buf[place])):
                known[name].append(x)
    if known["key"]:
        anchor, key, ids, size, data = (np.concatenate(known[x]) for x in ("anchor", "key", "id", "size", "data"))
        starts = np.cumsum(size) - size
        own, low, high = least_and_greatest(key, ids, ids)
        _, first = np.unique(key, return_index=True)
        order = np.argsort(anchor[first], kind="stable")
        first, own, low, high = first[order], own[order], low[order], high[order]
        grp = group.column("grp")[0].as_py()
        for b, i, j in by_bucket(anchor[first], buckets):
            place, _ = ragged(starts[first[i:j]], size[first[i:j]])
            rows.append((b, grp, anchor[first[i:j]].tobytes(), own[i:j].tobytes(), pack(low[i:j]),
                         greatest(low[i:j], high[i:j]),
                         size[first[i:j]].astype(np.uint16).tobytes(), data[place].tobytes()))
    return _arrow(rows, SENT)


def _arrow(rows: list[tuple], schema: str) -> pa.Table:
    kinds = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], pa.int64() if kind == "long" else pa.binary())
                     for k, (name, kind) in enumerate(kinds)})


def common_prefix_intervals(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``text`` (symbols from 0 to 256) and, per row, whether it begins an interval of suffixes
    whose first ``length`` symbols are equal.

    The order is by the first 56 symbols or more.  ``back[j]`` is the row of
    the suffix that row j becomes when its first symbol is taken away: rows
    j - 1 and j are in one interval of depth d + 1 if they begin alike and
    their rests are in one interval of depth d, that is if both come from the
    same interval by the same backward extension.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.int64)
    rank = np.zeros(n, np.int64)
    for k in range(7):
        rank = rank << 9 | padded[k:k + n]
    order = np.argsort(rank)
    inner = rank[order]
    new = np.concatenate([[True], inner[1:] != inner[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 7
    while depth < length:  # ranks by twice as many symbols; rows that stand alone stay where they are
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        nxt = np.minimum(at + depth, n - 1)
        key = rank[at] * (n + 1) + np.where(at + depth < n, rank[nxt] + 1, 0)
        inner = np.argsort(key)
        at, key = at[inner], key[inner]
        order[tied] = at
        new[tied[1:]] |= key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        depth *= 2
    row = np.empty(n + 1, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    row[n] = n
    symbol = text[order]
    begins = np.concatenate([[True], symbol[1:] != symbol[:-1]])
    rows = np.flatnonzero(~begins)
    back, before = row[order[rows] + 1], row[order[rows - 1] + 1]
    for _ in range(1, length):
        if not len(rows):
            break
        interval = np.append(np.cumsum(begins, dtype=np.int32), np.int32(0))
        apart = interval[back] != interval[before]
        begins[rows[apart]] = True
        rows, back, before = rows[~apart], back[~apart], before[~apart]
    return order, begins


def _window_ids(data: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id at each window of the given segments, segment by segment."""
    text = np.zeros(len(data) + len(size), np.int16)
    start = np.cumsum(size + 1) - size - 1
    place, own = ragged(start, size)
    text[place] = data.astype(np.int16) + 1
    order, begins = common_prefix_intervals(text, LENGTH)
    at = np.full(len(text), np.iinfo(np.int64).max)
    window, own = ragged(start, size - LENGTH + 1)
    at[window] = ids[own]
    first = np.flatnonzero(begins)
    least = np.empty(len(text), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(at[order], first), np.diff(np.append(first, len(text))))
    return least[window]


def _decide(bucket: pa.Table) -> pa.Table:
    blobs = {x: bucket.column(x).to_pylist() for x in ("anchors", "keys", "low", "high", "sizes", "data")}
    n = np.array([len(x) // 8 for x in blobs["keys"]])
    whole = lambda x, kind: np.frombuffer(b"".join(blobs[x]), kind)
    anchor, key, size = whole("anchors", np.uint64), whole("keys", np.uint64), whole("sizes", np.uint16).astype(np.int64)
    low = [unpack(x, k) for x, k in zip(blobs["low"], n, strict=True)]
    high = np.concatenate([with_greatest(x, y) for x, y in zip(low, blobs["high"], strict=True)])
    low = np.concatenate(low)
    data = whole("data", np.uint8)
    starts = np.cumsum(size) - size
    own, ids, _ = least_and_greatest(key, low, low)
    first = np.unique(key, return_index=True)[1]
    order = np.argsort(anchor[first], kind="stable")
    count = size[first] - LENGTH + 1
    offset = np.cumsum(count) - count
    least = np.empty(int(count.sum()), np.int64)
    at = 0
    weight = np.cumsum(size[first][order])
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(weight, weight[at] + TRANSFORM_BYTES)))
        while to < len(order) and anchor[first[order[to]]] == anchor[first[order[to - 1]]]:
            to += 1
        part = order[at:to]
        place, _ = ragged(starts[first[part]], size[first[part]])
        target, _ = ragged(offset[part], count[part])
        least[target] = _window_ids(data[place], size[first[part]], ids[part])
        at = to
    entry = np.searchsorted(own, key)
    lowest = np.minimum.reduceat(least, offset) if len(offset) else least
    row = np.repeat(np.arange(len(n)), n)
    grp, out = bucket.column("grp").to_numpy(), []
    for r, i, j in row_runs(row):
        on = np.flatnonzero(lowest[entry[i:j]] < high[i:j]) + i
        if len(on):
            value, _ = ragged(offset[entry[on]], count[entry[on]])
            out.append((int(grp[r]), key[on].tobytes(), count[entry[on]].astype(np.uint8).tobytes(), pack(least[value]),
                        key[on][anchor[on] == key[on]].tobytes()))
    return _arrow(out, ANSWER)


def _finish(group: pa.Table, answers: pa.Table) -> pa.Table:
    copies = is_copy(group, answers)
    answers = answers.filter(pa.compute.is_valid(answers.column("keys")))
    blobs = {x: column_bytes(answers, x) for x in ("keys", "counts", "least")}
    keys = np.frombuffer(b"".join(blobs["keys"]), np.uint64)
    count = np.frombuffer(b"".join(blobs["counts"]), np.uint8).astype(np.int64)
    least = np.concatenate([np.zeros(0, np.int64), *(unpack(x, int(np.frombuffer(c, np.uint8).sum()))
                                                     for x, c in zip(blobs["least"], blobs["counts"], strict=True))])
    offset = np.cumsum(count) - count
    order = np.argsort(keys)
    keys, offset = keys[order], offset[order]
    alone = shared_anchors(answers, "alone")
    n_bytes, n_removed, n_spans, kept = [], [], [], []
    for buf, offsets, ids, copy in _slices(group, copies):
        size = np.diff(offsets)
        gone = np.repeat(copy & (size >= LENGTH), size)
        if len(keys):
            found = Segments(buf, offsets)
            known, at = find(found.keys(), keys)
            known &= count[order[at]] == found.count
            value, own = ragged(offset[at[known]], found.count[known])
            start, _ = ragged(found.first[known], found.count[known])
            start = start[least[value] < ids[found.text[known]][own]]
            gone |= covered(len(buf), start, start + LENGTH)
            if len(alone):
                start, own = ragged(found.first[~known], found.count[~known])
                windows = found.windows(start)
                on = find(windows, alone)[0]
                value = offset[np.searchsorted(keys, windows[on])]
                start = start[on][least[value] < ids[found.text[~known][own[on]]]]
                gone |= covered(len(buf), start, start + LENGTH)
        begins, _ = runs(gone, offsets)
        n_bytes.append(np.diff(offsets))
        n_removed.append(sums_by(offsets, gone))
        n_spans.append(np.bincount(np.searchsorted(offsets, begins, "right") - 1, minlength=len(ids)))
        size = n_bytes[-1] - n_removed[-1]
        kept.append(pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ids),
            [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(buf[~gone])]).cast(pa.binary()))
    flat = lambda xs: pa.array(np.concatenate([np.zeros(0, np.int64), *xs]), pa.int64())
    return pa.table({"doc_id": group.column("doc_id"), "n_bytes": flat(n_bytes), "n_removed": flat(n_removed),
                     "n_spans": flat(n_spans), "kept": pa.chunked_array(kept, pa.binary())})


def remove_repeated_bytes(docs: DataFrame, group_bytes: int = GROUP_BYTES, hot: int = HOT) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs) and ``kept`` (binary)."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return two_rounds(docs, _anchors, _segments, _decide, _finish, SENT, ANSWER,
                      "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", group_bytes, hot)
