"""Benchmark decontamination by Wu-Manber search for runs of words.

The strings searched for are the windows of each benchmark item: ``WINDOW``
consecutive words, or all words of a shorter item.  Windows of one length form
one searcher.  Its symbols are words (by a 64-bit hash), its blocks pairs of
words: a shift table says for every block how far the search may move without
missing an end of a window, blocks that end a window lead to a bucket of
windows with that suffix, and direct comparison, by word hash and then by the
words themselves, confirms.  Many stretches of a batch move through the table
at once.

The benchmark is a stated query set: it is taken in blocks of at most
``BLOCK_BYTES`` of item text (an item longer than that is a block of its own),
each broadcast, and the documents pass through the blocks one after another in
the same stage, with no shuffle.

Defined results.  Null or empty text has no words and no hits.  An empty
benchmark, or items without words, hit nothing.  Items are told apart by
``item_id``; all items without one count as one item and appear in no id list.
Repeated documents are judged each for itself.  Other columns are kept; the
added ones begin with ``bench_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .kernels import ALNUM, Words, covered, lists, mix, ragged, row_slices, runs, sums_by, text_bytes, word_run_hash, \
    word_run_sums

WINDOW = 10
BLOCK_BYTES = 4 << 20
STRETCH = 512
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Searcher:
    """Windows of ``m`` words: ``at[p]`` is where window p begins in the item words ``hashes``."""

    def __init__(self, m: int, at: np.ndarray, hashes: np.ndarray):
        self.m, self.b = m, min(2, m)
        self.bits = int(np.clip(np.ceil(np.log2(8 * len(at) * m + 1)), 10, 22))
        blocks = [self._block(hashes, at + j) for j in range(self.b - 1, m)]
        self.shift = np.full(1 << self.bits, m - self.b + 1, np.uint8)
        for j, h in enumerate(blocks):
            np.minimum.at(self.shift, h, np.uint8(m - self.b - j))
        order = np.argsort(blocks[-1], kind="stable")
        self.at = at[order]
        self.bucket = np.searchsorted(blocks[-1][order], np.arange((1 << self.bits) + 1))
        self.order = order

    def _block(self, hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = hashes[end] if self.b == 1 else hashes[end - 1] * _PAIR + hashes[end]
        return (mix(x) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Last words of the places where the shift is 0."""
        low, high = first[:-1] + self.m - 1, first[1:]
        stretches = np.maximum(0, -(-(high - low) // STRETCH))
        pos, own = ragged(np.zeros_like(low), stretches)
        pos = low[own] + pos * STRETCH
        stop = np.minimum(pos + STRETCH, high[own])
        found = []
        while len(pos):
            step = self.shift[self._block(hashes, pos)]
            found.append(pos[step == 0])
            pos = pos + np.maximum(step, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def matches(self, words: Words, hashes: np.ndarray, items: Words, item_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(first word, window)`` of every occurrence."""
        end = self.candidates(hashes, words.first)
        h = self._block(hashes, end)
        entry, own = ragged(self.bucket[h], self.bucket[h + 1] - self.bucket[h])
        start, at = end[own] - self.m + 1, self.at[entry]
        for j in range(self.m):
            same = hashes[start + j] == item_hashes[at + j]
            start, at, entry = start[same], at[same], entry[same]
        same = np.array([words.joined(s, s + self.m) == items.joined(a, a + self.m)
                         for s, a in zip(start, at, strict=True)], dtype=bool)
        return start[same], self.order[entry[same]]


class Benchmark:
    """One block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[str | None, str]]):
        ids = list(dict.fromkeys(i for i, _ in items))
        number = {x: k for k, x in enumerate(ids)}
        self.ids = np.array(ids, dtype=object)
        buf, offsets = text_bytes(pa.array([t or "" for _, t in items], pa.large_string()))
        self.words = Words(buf, offsets, ALNUM, lower=True)
        self.hashes = self.words.hashes()
        of_item = np.array([number[i] for i, _ in items], dtype=np.int64)
        n = self.words.counts()
        length = np.minimum(n, WINDOW)
        sums = word_run_sums(self.hashes)
        self.searchers = []
        for m in sorted(set(length.tolist()) - {0}):
            which = np.flatnonzero(length == m)
            at, own = ragged(self.words.first[which], n[which] - m + 1)
            _, where, window = np.unique(word_run_hash(sums, at, m), return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([window, of_item[which][own]], 1), axis=0)
            holds = np.searchsorted(pairs[:, 0], np.arange(len(where) + 1))
            self.searchers.append((Searcher(m, at[where], self.hashes), holds, pairs[:, 1]))

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``hit`` per word, and distinct ``(text, item number)`` pairs."""
        hashes, of = words.hashes(), words.of_text()
        begins, ends, texts, items = [], [], [], []
        for searcher, holds, item in self.searchers:
            start, window = searcher.matches(words, hashes, self.words, self.hashes)
            begins.append(start)
            ends.append(start + searcher.m)
            pairs = np.unique(np.stack([of[start], window], 1), axis=0).reshape(-1, 2)
            entry, own = ragged(holds[pairs[:, 1]], holds[pairs[:, 1] + 1] - holds[pairs[:, 1]])
            texts.append(pairs[own, 0])
            items.append(item[entry])
        if not begins:
            return np.zeros(len(words), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = covered(len(words), np.concatenate(begins), np.concatenate(ends))
        pairs = np.unique(np.stack([np.concatenate(texts), np.concatenate(items)], 1), axis=0)
        return hit, pairs[:, 0], pairs[:, 1]


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Benchmark]:
    """The items in blocks of bounded size, read one row after another."""
    block: list[tuple[str | None, str]] = []
    held = 0
    rows = benchmark.select(F.col("item_id").cast("string"), "text").distinct()
    for item, text in rows.toLocalIterator():
        size = len((text or "").encode())
        if block and held + size > block_bytes:
            yield Benchmark(block)
            block, held = [], 0
        block.append((item, text or ""))
        held += size
    if block:
        yield Benchmark(block)


def _searched(known, add: bool):
    """A function over Arrow batches; with ``add``, the result columns are new, else they are the last three."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = known.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for lo, n in row_slices(text):
                part = batch.slice(lo, n)
                buf, offsets = text_bytes(part.column(batch.schema.get_field_index("text")))
                words = Words(buf, offsets, ALNUM, lower=True)
                hit, at, item = bench.search(words)
                found: list[list] = [[] for _ in range(n)]
                for t, i in zip(at.tolist(), item.tolist(), strict=True):
                    found[t].append(bench.ids[i])
                if not add:
                    before = part.column(part.num_columns - 2)
                    flat = before.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
                    base = np.repeat(words.first[:-1], before.value_lengths().to_numpy(zero_copy_only=False) // 2)
                    hit |= covered(len(words), base + flat[:, 0], base + flat[:, 1])
                    for t, old in enumerate(part.column(part.num_columns - 1).to_pylist()):
                        found[t] = list(dict.fromkeys(old + found[t]))
                a, b = runs(hit, words.first)
                of = np.searchsorted(words.first, a, "right") - 1
                flat = np.stack([a - words.first[of], b - words.first[of]], 1).reshape(-1)
                spans = lists(2 * np.bincount(of, minlength=n), pa.array(flat, pa.int64()))
                own = [pa.array(words.counts(), pa.int64()), pa.array(sums_by(words.first, hit), pa.int64()), spans,
                       pa.array(found, pa.list_(pa.string()))]
                keep = part.columns if add else part.columns[:-4]
                names = part.schema.names if add else part.schema.names[:-4]
                yield pa.RecordBatch.from_arrays([*keep, *own], [*names, *RESULT.names])
    return run


RESULT = T.StructType([
    T.StructField("bench_words", T.LongType()), T.StructField("bench_hits", T.LongType()),
    T.StructField("bench_spans", T.ArrayType(T.LongType())), T.StructField("bench_items", T.ArrayType(T.StringType()))])


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` plus ``bench_words``, ``bench_hits`` (words inside an occurrence), ``bench_spans`` (runs of hit
    words: begin, end, begin, end, ...) and ``bench_items`` (ids of the items with an occurrence)."""
    out, spark = docs, docs.sparkSession
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])
    blocks = benchmark_blocks(benchmark, block_bytes)
    for k, block in enumerate(blocks):
        out = out.mapInArrow(_searched(spark.sparkContext.broadcast(block), k == 0), schema)
    if out is docs:
        out = docs.mapInArrow(_searched(spark.sparkContext.broadcast(Benchmark([])), True), schema)
    return out
