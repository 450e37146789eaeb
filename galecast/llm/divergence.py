"""Source divergence audit: how far the sources of a language are apart in their words.

Terms are runs of letters, split by numpy in the tasks.  Every language has its own vocabulary, the terms in
at least ``min_df`` of its documents.  A ``CountVectorizer`` with that minDF and
the greatest integer as its vocabulary size, so that nothing is cut, gives the
vocabulary and exact sparse vectors.  It is fitted once for all languages: a
term carries its language in front, so the counts of documents are those of
single languages, and no pass is made per language.  Its rows are bundles of
texts, in which numpy tells terms apart by a 64-bit hash.  Texts are split and counted once: the bundles are
stored, and both the fit and the vectors read them.  For the fit, the bundles' terms are brought together in ``PARTS`` parts,
and a term that ``k`` texts have is in ``min(k, min_df)`` rows, which leaves its test against ``min_df`` as it is; for the vectors, the
terms that a group's texts of a bundle have equally often are one row, with that number as
its weight.  So the vectoriser gets a term a few times, not once a text.  Group sums are taken over
the vectors' entries in whole numbers (a summariser's means and weights would
round).  Smoothed shares ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))`` follow
in exact decimals.  Pairs of sources are evaluated in blocks of ``BLOCK`` terms
of one language: a block holds the entries of all its sources, takes the
absolute differences of all pairs over the terms that any of them has, and
hands on one sum a pair.  Every kept term occurs in some source of its language, so no
term is left out.

The vectoriser keeps its vocabulary on the driver and on every worker.  A first
pass over every ``SAMPLE``-th row estimates the distinct terms there.  A kept term has 30 documents and is
missed by chance 0.14 each, so kept terms are hardly more than these by a sixth;
over ``MAX_TERMS`` of them the vectors' entries are
built as rows, by aggregates and a join on the term, with the same results.

Defined results.  Null text, lang and source are ''.  Equal rows count as often
as they occur.  A language without kept terms has pairs of value 0 and no terms;
a source that is alone in its language has no pairs.  No documents, no rows.
Other columns are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.joins import attach_groups
from ..session import drop_staged, stage_table
from .kernels import BYTE_BASE, LETTERS, Words, lists, mix, ragged, row_slices, run_hash, running, text_bytes

MIN_DF, TOP_TERMS, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
MAX_TERMS, SAMPLE, BLOCK = 2_000_000, 16, 4096
#: Entries held at once for a bundle, vector entries summed at once, strings made at once, rows handed on at once, parts of the
#: terms that are summed apart.
ENTRIES, VALUES, STRINGS, ROWS, PARTS = 1 << 18, 1 << 19, 1 << 16, 32, 256
GREATEST_INT = (1 << 31) - 1
#: Terms hold no character up to 0x40, so what stands before the last of these is the language.
_MARK = "\x01"
_ENTRY = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def _tagged(distinct: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``lang, source, terms``: an empty term, then the lowered terms of each text (or each once) with their language in front."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in row_slices(batch.column(2)):
                part = batch.slice(lo, n)
                words = Words(*text_bytes(part.column(2)), LETTERS, lower=True)
                of, begin, end = words.of_text(), words.start, words.end
                if distinct:
                    hashes = words.hashes()
                    order = np.lexsort((hashes, of))
                    own = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])) if len(of) else order
                    at = order[np.flatnonzero(own)]
                    of, begin, end = of[at], begin[at], end[at]
                tags = [(lang + _MARK).encode() for lang in part.column(0).to_pylist()]
                size = np.array([len(t) for t in tags], np.int64)
                # A text's pieces: nothing, then tag, term, tag, term, ...
                starts = np.stack([len(words.norm) + (np.cumsum(size) - size)[of], begin], 1).reshape(-1)
                sizes = np.stack([size[of], end - begin], 1)
                data = np.concatenate([words.norm, np.frombuffer(b"".join(tags), np.uint8)])[ragged(starts, sizes.reshape(-1))[0]]
                upto, counts = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]), np.bincount(of, minlength=n)
                first = np.cumsum(counts) - counts
                ends = np.concatenate([[0], np.insert(upto[1:], first, upto[first])])
                values = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()),
                                                          pa.py_buffer(data.tobytes())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(counts + 1, values)], ["lang", "source", "terms"])
    return run


def tagged_terms(docs: DataFrame, distinct: bool = False) -> DataFrame:
    """The terms of each text; ``distinct``: told apart by a 64-bit hash within the text."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return texts.mapInArrow(_tagged(distinct), "lang string, source string, terms array<string>")


def _groups(batch: pa.RecordBatch, columns: Sequence[int], groups: dict[tuple[str, ...], int]) -> np.ndarray:
    """The number of each row's group; new groups are added."""
    values = zip(*[batch.column(c).to_pylist() for c in columns], strict=True)
    return np.array([groups.setdefault(g, len(groups)) for g in values], np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return np.flatnonzero(new)


class _Counter:
    """How often each group has each term, and in how many texts, over a number of texts."""

    def __init__(self):
        self.parts, self.held, self.groups, self.texts = [], 0, {}, np.zeros(0, np.int64)

    def add(self, part: pa.RecordBatch) -> None:
        code = _groups(part, (0, 1), self.groups)
        self.texts = np.bincount(code, minlength=len(self.groups)) + np.pad(self.texts, (0, len(self.groups) - len(self.texts)))
        # With the texts of a group on end, a stable sort by term leaves groups and texts in order.
        order = np.argsort(code, kind="stable")
        words = Words(*text_bytes(part.column(2).take(pa.array(order))), LETTERS, lower=True)
        of, hashes = words.of_text(), words.hashes()
        at = np.argsort(hashes, kind="stable")
        of, hashes = of[at], hashes[at]
        group, own = code[order][of], np.zeros(len(at), np.int64)
        first, own[_starts(hashes, of)] = _starts(hashes, group), 1
        starts, ends = words.start[at[first]], words.end[at[first]]
        self.parts.append((_keys(hashes[first], group[first]), group[first], hashes[first], np.diff(np.append(first, len(at))),
                           _totals(own, first), _terms(ends - starts, words.norm[ragged(starts, ends - starts)[0]])))
        self.held += len(first)

    def merge(self) -> None:
        self.parts = [_merged(self.parts, 2)]
        self.held = len(self.parts[0][0])

    def bundle(self) -> _Bundle:
        self.merge()
        _, group, hashes, counts, texts, terms = self.parts[0]
        names = list(self.groups)
        tongue = _numbers([lang for lang, _ in names])[group]
        keys = _keys(hashes, tongue)
        order = np.argsort(keys)
        first = _starts(keys[order])
        at, term = order[first], np.empty(len(order), np.int64)
        term[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        return _Bundle(names, self.texts, tongue[at], _totals(texts[order], first), terms.take(pa.array(at)), group, term, counts)


class _Bundle(NamedTuple):
    """Terms of a number of texts: each language's once, with its number of texts, and how often each group has which."""

    groups: list[tuple[str, str]]  # language and source
    texts: np.ndarray  # of each group
    tongue: np.ndarray  # of each term: the number of its language, by first appearance in ``groups``
    held: np.ndarray  # of each term: in how many texts it is
    terms: pa.Array
    group: np.ndarray  # of each entry
    term: np.ndarray
    count: np.ndarray

    def stored(self) -> pa.RecordBatch:
        """One row, with the arrays of terms and entries as their bytes."""
        sizes = pc.binary_length(self.terms).to_numpy(zero_copy_only=False)
        data = self.terms.buffers()[2]
        blobs = [_packed(x) for x in (self.tongue, self.held, sizes, self.group, self.term, self.count)]
        names = [pa.array([[g[k] for g in self.groups]], pa.list_(pa.string())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(
            [*names, pa.array([self.texts.tolist()], pa.list_(pa.int64())),
             *[pa.array([x], pa.binary()) for x in (*blobs, data.to_pybytes()[:int(sizes.sum())] if data else b"")]], _STORED)


_STORED = ["lang", "source", "texts", "tongue", "held", "size", "group", "term", "count", "data"]
_STORED_TYPES = "lang array<string>, source array<string>, texts array<long>, " + ", ".join(f"{c} binary" for c in _STORED[3:])


def _tagged_terms(langs: list[str], tongue: np.ndarray, terms: pa.Array) -> pa.Array:
    """Terms with their language in front."""
    tags, nothing = pa.array([(lang + _MARK).encode() for lang in langs], pa.large_binary()), pa.scalar(b"", pa.large_binary())
    parts = [pc.binary_join_element_wise(tags.take(pa.array(tongue[lo:lo + STRINGS])), terms.slice(lo, STRINGS), nothing)
             for lo in range(0, len(terms), STRINGS)]
    return pa.concat_arrays(parts).cast(pa.string()) if parts else pa.array([], pa.string())


def _numbers(values: list[str]) -> np.ndarray:
    """The place of each value among the different ones, by first appearance."""
    places: dict[str, int] = {}
    return np.array([places.setdefault(v, len(places)) for v in values], np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as they need, and the code of their type in front."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return kind.char.encode() + numbers.astype(kind).tobytes()


def _unpacked(data: pa.Buffer) -> np.ndarray:
    return np.frombuffer(data[1:], data[:1].to_pybytes().decode()).astype(np.int64)


def _hashes(terms: pa.Array) -> np.ndarray:
    """Those that ``Words`` gives the terms in a text."""
    ends = np.frombuffer(terms.buffers()[1], np.int64)[:len(terms) + 1]
    sums = running(np.frombuffer(terms.buffers()[2], np.uint8)[:ends[-1]].astype(np.uint64) + np.uint64(1), BYTE_BASE)
    return run_hash(sums, ends[:-1], ends[1:], BYTE_BASE)


def _keys(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Hashes of terms and groups together."""
    return mix(hashes + mix(group.astype(np.uint64) + np.uint64(1)))


def _merged(parts: Sequence[tuple], sums: int) -> tuple:
    """Rows of keys, numbers and terms, once for each key; the last ``sums`` numbers are added up."""
    *numbers, terms = zip(*parts, strict=True)
    numbers = [np.concatenate(x) for x in numbers]
    order = np.argsort(numbers[0])
    first = _starts(numbers[0][order])
    at = order[first]
    return (*[x[at] for x in numbers[:-sums]], *[_totals(x[order], first) for x in numbers[-sums:]],
            pa.concat_arrays(terms).take(pa.array(at)))


def _totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _terms(sizes: np.ndarray, data: np.ndarray | bytes) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _restored(batch: pa.RecordBatch) -> Iterator[_Bundle]:
    for r in range(len(batch)):
        row = {c: batch.column(c)[r] for c in _STORED}
        tongue, held, sizes, group, term, count = (_unpacked(row[c].as_buffer()) for c in _STORED[3:-1])
        yield _Bundle(list(zip(row["lang"].as_py(), row["source"].as_py(), strict=True)), np.array(row["texts"].as_py(), np.int64),
                      tongue, held, _terms(sizes, row["data"].as_buffer()), group, term, count)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[_Bundle]:
    """Bundles of texts (``lang, source, text``), or those that were stored.

    Equal terms of a group are added up whenever ``ENTRIES`` are held, and a bundle ends when three quarters as many are different.
    """
    counter = _Counter()
    for batch in batches:
        if "data" in batch.schema.names:
            yield from _restored(batch)
            continue
        for lo, n in row_slices(batch.column(2)):
            counter.add(batch.slice(lo, n))
            if counter.held >= ENTRIES:
                counter.merge()
                if counter.held >= ENTRIES * 3 // 4:
                    yield counter.bundle()
                    counter = _Counter()
    if counter.parts:
        yield counter.bundle()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bundle in _bundles(batches):
        yield bundle.stored()


class _Languages:
    """The terms of each language of some bundles, and in how many of their texts they are."""

    def __init__(self):
        self.parts, self.held, self.names, self.texts = [], 0, {}, np.zeros(0, np.int64)

    def add(self, bundle: _Bundle) -> None:
        own = np.array([self.names.setdefault(lang, len(self.names)) for lang, _ in bundle.groups], np.int64)
        self.texts = np.pad(self.texts, (0, len(self.names) - len(self.texts)))
        np.add.at(self.texts, own, bundle.texts)
        tongue = np.array(list(dict.fromkeys(own.tolist())), np.int64)[bundle.tongue]
        hashes = _hashes(bundle.terms)
        self.parts.append((_keys(hashes, tongue), hashes, tongue, bundle.held, bundle.terms))
        self.held += len(tongue)
        if self.held >= ENTRIES:
            self.merge()

    def merge(self) -> None:
        self.parts = [_merged(self.parts, 1)]
        self.held = len(self.parts[0][0])

    def bundles(self, parts: int = 1) -> Iterator[_Bundle]:
        """A bundle without entries for each of some parts of the terms."""
        self.merge()
        _, hashes, tongue, held, terms = self.parts[0]
        of, none = (hashes % np.uint64(parts)).astype(np.int64), np.zeros(0, np.int64)
        order, upto = np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=parts))
        for at in np.split(order, upto[:-1]):
            yield _Bundle([(lang, "") for lang in self.names], self.texts, tongue[at], held[at], terms.take(pa.array(at)), none, none, none)


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part`` and the stored bundle of its terms, for each of ``PARTS`` parts, of three quarters of ``ENTRIES`` different ones at a time."""
    def rows(langs: _Languages) -> pa.RecordBatch:
        parts = pa.Table.from_batches([b.stored() for b in langs.bundles(PARTS)]).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), *[c.chunk(0) for c in parts.columns]], ["part", *_STORED])

    langs = _Languages()
    for bundle in _bundles(batches):
        langs.add(bundle)
        if langs.held >= ENTRIES * 3 // 4:
            langs.merge()
            if langs.held >= ENTRIES * 3 // 4:
                yield rows(langs)
                langs = _Languages()
    if langs.parts:
        yield rows(langs)


def _whole_bundle(part: pa.Table) -> pa.RecordBatch:
    """All terms of one part, with their numbers of texts in the whole table."""
    langs = _Languages()
    for batch in part.to_batches():
        for bundle in _restored(batch):
            langs.add(bundle)
    return next(langs.bundles()).stored()


def _whole_presences(cap: int) -> Callable[[pa.Table], pa.Table]:
    """The rows of ``_presences`` for all terms of one part, in the same worker."""
    return lambda part: pa.Table.from_batches(list(_presences(cap)(iter([_whole_bundle(part)]))), pa.schema([("terms", pa.list_(pa.string()))]))


def _presences(cap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``terms``: per bundle and language, row ``j`` holds the terms of at least ``j`` texts, up to ``cap`` rows.

    Every row also holds the empty term; there are as many as the language has texts, or ``cap``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle in _bundles(batches):
            langs = list(dict.fromkeys(lang for lang, _ in bundle.groups))
            texts = np.bincount(_numbers([lang for lang, _ in bundle.groups]), bundle.texts).astype(np.int64)
            # The empty term is the last.
            terms = pa.concat_arrays([_tagged_terms(langs, bundle.tongue, bundle.terms), pa.array([""], pa.string())])
            own = np.argsort(bundle.tongue, kind="stable")
            for j in range(1, cap + 1):
                present, own = np.flatnonzero(texts >= j), own[bundle.held[own] >= j]
                if not len(present):
                    break
                place = np.concatenate([present, bundle.tongue[own]])
                at = np.concatenate([np.full(len(present), len(bundle.held)), own])[np.argsort(place, kind="stable")]
                yield from _cut(pa.RecordBatch.from_arrays([lists(np.bincount(place)[present], terms.take(pa.array(at)))], ["terms"]))
    return run


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, weight, terms``: the terms that a bundle's texts of a group have ``weight`` times."""
    for bundle in _bundles(batches):
        order = np.lexsort((bundle.count, bundle.group))
        group, count = bundle.group[order], bundle.count[order]
        first, langs = _starts(group, count), list(dict.fromkeys(lang for lang, _ in bundle.groups))
        terms = _tagged_terms(langs, bundle.tongue, bundle.terms)
        own = pa.array(group[first])
        yield from _cut(pa.RecordBatch.from_arrays(
            [*[pa.array([g[k] for g in bundle.groups], pa.string()).take(own) for k in (0, 1)], pa.array(count[first], pa.int64()),
             lists(np.diff(np.append(first, len(order))), terms.take(pa.array(bundle.term[order])))], ["lang", "source", "weight", "terms"]))


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, so that the reader holds few terms at once."""
    for lo in range(0, len(batch), ROWS):
        yield batch.slice(lo, ROWS)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, lang, source, of, ix, count``: sums of the weighted vectors' entries by group, of a bounded number of entries
    at a time, as arrays for each of ``PARTS`` parts of the vocabulary (``of``: places in ``lang`` and ``source``)."""
    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy())])
        lo = 0
        while lo < len(batch):
            n = max(1, int(np.searchsorted(upto, upto[lo] + VALUES, "right")) - 1 - lo)
            part = batch.slice(lo, n)
            groups: dict[tuple[str, ...], int] = {}
            own = np.diff(upto[lo:lo + n + 1])
            of, ix = np.repeat(_groups(part, (0, 1), groups), own), part.column(3).flatten().to_numpy()
            # Whole numbers below 2**53 in doubles, added as such.
            count = np.repeat(part.column(2).to_numpy(), own) * part.column(4).flatten().to_numpy().astype(np.int64)
            of, ix, count = _added(of, ix, count)
            order = np.argsort(ix % PARTS, kind="stable")
            sizes = np.bincount(ix % PARTS, minlength=PARTS)
            at = np.flatnonzero(sizes)
            names = [pa.array([[g[k] for g in groups]] * len(at), pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), *names, *[lists(sizes[at], pa.array(x[order], t)) for x, t in
                                                     ((of, pa.int32()), (ix, pa.int32()), (count, pa.int64()))]],
                ["part", "lang", "source", "of", "ix", "count"])
            lo += n


def _added(of: np.ndarray, ix: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = of.astype(np.int64) << 32 | ix
    order = np.argsort(key, kind="stable")
    at = _starts(key[order])
    return of[order[at]], ix[order[at]], np.add.reduceat(count[order], at) if len(at) else count


def _whole_sums(part: pa.Table) -> pa.Table:
    """``lang, source, ix, count``: the sums of one part of the vocabulary."""
    part = part.combine_chunks()
    groups: dict[tuple[str, str], int] = {}
    of, ix, count = [], [], []
    for r in range(len(part)):
        names = zip(part.column("lang")[r].as_py(), part.column("source")[r].as_py(), strict=True)
        code = np.array([groups.setdefault(g, len(groups)) for g in names], np.int64)
        of.append(code[part.column("of")[r].values.to_numpy()])
        ix.append(part.column("ix")[r].values.to_numpy())
        count.append(part.column("count")[r].values.to_numpy())
    of, ix, count = _added(*[np.concatenate(x) for x in (of, ix, count)])
    names = [pa.array([g[k] for g in groups], pa.string()).take(pa.array(of)) for k in (0, 1)]
    return pa.table([*names, pa.array(ix, pa.int32()), pa.array(count, pa.int64())], ["lang", "source", "ix", "count"])


def _by_vectors(docs: DataFrame, min_df: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, source, ix, count)`` and ``(ix, lang, term)`` through vectors of bundles of documents.

    A term is in ``min_df`` documents exactly if it is in so many of the rows that the vectoriser is fitted on (``_presences``).
    The empty term is in a row of every document up to ``min_df``, so a vocabulary is never empty where there are so many documents.
    """
    counter = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=GREATEST_INT)
    bundles = stage_table(_texts(docs).mapInArrow(_counted, _STORED_TYPES), "divergence-bundles")
    parts = bundles.mapInArrow(_parted, f"part int, {_STORED_TYPES}")
    model = counter.fit(parts.groupBy("part").applyInArrow(_whole_presences(min_df), "terms array<string>"))
    bags = bundles.mapInArrow(_bags, "lang string, source string, weight long, terms array<string>")
    vectors = stage_table(model.transform(bags).select("lang", "source", "weight", "vector"), "divergence-vectors")
    drop_staged(bundles)
    spark = docs.sparkSession
    # The same files, with the vectors as the structs that they are stored as.
    stored = spark.read.schema(f"lang string, source string, weight long, vector {_ENTRY}").parquet(vectors._staged_path)
    entries = stored.select("lang", "source", "weight", F.col("vector.indices").alias("indices"), F.col("vector.values").alias("values"))
    sums = entries.mapInArrow(_sums, "part int, lang array<string>, source array<string>, of array<int>, ix array<int>, count array<long>")
    counts = sums.groupBy("part").applyInArrow(_whole_sums, "lang string, source string, ix int, count long")
    known = pa.table({"ix": pa.array(range(len(model.vocabulary)), pa.int32()), "tagged": pa.array(model.vocabulary, pa.string())})
    words = spark.createDataFrame(known).where("tagged != ''")
    cut = F.length("tagged") - F.length(F.substring_index("tagged", _MARK, -1))
    vocabulary = words.select("ix", F.substring("tagged", F.lit(1), cut - 1).alias("lang"),
                              F.substring_index("tagged", _MARK, -1).alias("term"))
    counts = stage_table(counts, "divergence-counts")
    drop_staged(vectors)
    return counts, stage_table(vocabulary, "divergence-terms", small=True)


def _by_rows(docs: DataFrame, min_df: int) -> tuple[DataFrame, DataFrame]:
    """The same with terms as rows, for vocabularies that no driver should hold; ``ix`` is the tagged term itself."""
    held = tagged_terms(docs, distinct=True).select("lang", F.explode("terms").alias("ix")).where("ix != ''")
    kept = held.groupBy("lang", "ix").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    kept = stage_table(kept.select("ix", "lang", F.substring_index("ix", _MARK, -1).alias("term")), "divergence-terms")
    used = tagged_terms(docs).select("lang", "source", F.explode("terms").alias("ix")).where("ix != ''")
    counts = used.groupBy("lang", "source", "ix").agg(F.count("*").alias("count")).join(kept.select("ix"), "ix", "left_semi")
    return stage_table(counts.select("lang", "source", "ix", "count"), "divergence-counts"), kept


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE (count + PRIOR) / (total + PRIOR kept))`` in exact numbers of any size."""
    whole = "decimal(38,0)"
    return F.lit(1) + F.call_function("div", (F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")).cast(whole),
                                      (total + F.lit(PRIOR) * kept).cast(whole))


def _pair_sums(key, entries: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of absolute differences of all pairs of a block's sources, over the terms of the block."""
    names = groups.column("source").to_pylist()
    place = {s: k for k, s in enumerate(names)}
    row = np.array([place[s] for s in entries.column("source").to_pylist()], np.int64)
    found, column = np.unique(entries.column("ix").to_numpy(zero_copy_only=False), return_inverse=True)
    p = np.repeat(groups.column("absent").to_numpy(zero_copy_only=False)[:, None], len(found), 1)
    p[row, column] = entries.column("p").to_numpy()
    one, two, value = [], [], []
    for a in range(len(names) - 1):
        one += [names[a]] * (len(names) - 1 - a)
        two += names[a + 1:]
        value.append(np.abs(p[a + 1:] - p[a]).sum(axis=1))
    lang = [key[0].as_py() if hasattr(key[0], "as_py") else key[0]] * len(one)
    return pa.table({"lang": pa.array(lang, pa.string()), "one": pa.array(one, pa.string()), "two": pa.array(two, pa.string()),
                     "value": pa.array(np.concatenate(value) if value else [], pa.int64())})


def audit(docs: DataFrame, min_df: int = MIN_DF, top_terms: int = TOP_TERMS, max_terms: int = MAX_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: per language and source, how far every other source is (part ``pair``,
    all ranks) and which terms it has more of than its language (part ``term``, the first ``top_terms``)."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])
    sample = tagged_terms(docs.sample(1 / SAMPLE, seed=1), distinct=True).select(F.explode("terms").alias("t"))
    distinct = sample.agg(F.approx_count_distinct("t")).first()[0]
    few = docs.limit(min_df).count() < min_df
    counts, vocabulary = (_by_rows if few or distinct > max_terms else _by_vectors)(docs, min_df)

    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept")])
    absent = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(F.lit(0))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / BLOCK)).cast("int")
    groups = stage_table(groups.select("*", absent.cast("long").alias("absent"), blocks.alias("blocks")), "divergence-groups", small=True)
    shares = attach_groups(counts, groups, ["lang", "source"], ["ix"]).withColumn(
        "p", share(F.col("count"), F.col("total"), F.col("kept")).cast("long"))

    entries = shares.select("lang", "source", "ix", "p", F.pmod(F.xxhash64("ix"), F.col("blocks")).cast("int").alias("block"))
    sources = groups.select("lang", "source", "absent", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    sums = (entries.groupBy("lang", "block").cogroup(sources.groupBy("lang", "block"))
            .applyInArrow(_pair_sums, "lang string, one string, two string, value long")
            .groupBy("lang", "one", "two").agg(F.sum("value").alias("value")))
    ways = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")),
                             F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("way")
    pairs = sums.select("lang", ways, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")

    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    term = Window.partitionBy("lang", "ix")
    more = shares.withColumn("everywhere", F.sum("count").over(term))
    more = attach_groups(more, stage_table(whole, "divergence-langs", small=True), ["lang"], ["ix"])
    more = more.withColumn("value", F.col("p") - share(F.col("everywhere"), F.col("all"), F.col("kept"))).where("value > 0")
    more = more.join(vocabulary, ["lang", "ix"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = (more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("value").cast("long").alias("value"))
           .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)
