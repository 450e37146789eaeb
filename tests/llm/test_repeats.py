"""Both removals of repeated runs against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from galecast.llm import rounds, substrings, suffixes
from . import cases


def plain_words(rows, window):
    least = {}
    for i, t, *_ in rows:
        w = cases.words(t)
        for p in range(len(w) - window + 1):
            g = tuple(w[p:p + window])
            least[g] = min(least.get(g, float("inf")), cases.rank(i))
    out = []
    for i, t, *_ in rows:
        w = cases.words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p:p + window])] < cases.rank(i):
                gone[p:p + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def plain_bytes(rows, length):
    least = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            least[b[p:p + length]] = min(least.get(b[p:p + length], float("inf")), cases.rank(i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p:p + length]] < cases.rank(i):
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def key(row):
    return repr(row)


@pytest.mark.parametrize("seed,group_bytes", [(1, 1 << 20), (2, 300)])
def test_words_equal_plain(spark, seed, group_bytes):
    rows = cases.documents(seed, 60, words=90, vocabulary=3 if seed == 2 else 30)
    got = substrings.remove_repeated_words(cases.frame(spark, rows, clashing=True), group_bytes).collect()
    assert sorted(map(key, (tuple(r) for r in got))) == sorted(map(key, plain_words(rows, 50)))


@pytest.mark.parametrize("seed,group_bytes", [(1, 1 << 20), (2, 300)])
def test_bytes_equal_plain(spark, seed, group_bytes):
    rows = cases.documents(seed, 60, words=60, vocabulary=3 if seed == 2 else 30)
    rows += [(700, "ab" * 400, "en", "a", 1), (701, "x" + "ab" * 300, "en", "a", 1), (702, "a" * 500, "en", "a", 1),
             (703, "a" * 49, "en", "a", 1), (704, "a" * 50, "en", "a", 1), (705, "\x00" * 60, "en", "a", 1)]
    got = suffixes.remove_repeated_bytes(cases.frame(spark, rows, clashing=True), group_bytes).collect()
    flat = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got]
    assert sorted(map(key, flat)) == sorted(map(key, plain_bytes(rows, 50)))


def test_empty_tables(spark):
    empty = cases.frame(spark, [])
    assert substrings.remove_repeated_words(empty).collect() == []
    assert suffixes.remove_repeated_bytes(empty).collect() == []


def test_cover_meets_every_shift():
    marks = set(substrings.COVER)
    for shift in range(substrings.PERIOD):
        assert any((c + shift) % substrings.PERIOD in marks for c in marks)
    assert substrings.ANCHOR + substrings.PERIOD - 1 == substrings.WINDOW


def test_intervals_are_the_classes_of_equal_prefixes():
    rng = random.Random(1)
    for alphabet in (2, 5, 256):
        text = np.array([rng.randrange(alphabet) + 1 for _ in range(400)] * 2 + [0], np.int16)
        for length in (1, 3, 50):
            order, begins = suffixes.common_prefix_intervals(text, length)
            assert sorted(order.tolist()) == list(range(len(text)))
            head = lambda p: tuple(text[p:p + length].tolist() + [0] * length)[:length]
            heads = [head(p) for p in order]
            assert [True] + [a != b for a, b in zip(heads, heads[1:])] == begins.tolist()
            assert len(set(heads)) == begins.sum()


@pytest.mark.parametrize("hot", [0, 3, 40])
def test_windows_around_a_hot_phrase_meet(spark, hot):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(30))
    before, after = [word() for _ in range(40)], [word() for _ in range(40)]
    phrase = "a phrase that many documents share"
    rows = [(i, rng.choice(before) + phrase + rng.choice(after), "en", "a", 1) for i in range(300)] + cases.documents(3, 30, words=60)
    got = suffixes.remove_repeated_bytes(cases.frame(spark, rows, clashing=True), 2000, hot).collect()
    flat = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got]
    assert sorted(map(key, flat)) == sorted(map(key, plain_bytes(rows, 50)))


def test_a_hot_hash_is_split_by_window():
    texts = [f"{i:040d} a phrase that many documents share {i:040d}" for i in range(200)] * 2
    group = pa.table({"doc_id": pa.array(range(400), pa.int64()), "text": texts, "digest": [str(i) for i in range(400)],
                      "grp": pa.array([0] * 400, pa.int64())})
    none = pa.table({"digest": pa.array([], pa.string()), "original": pa.array([], pa.int64())})
    largest = {}
    for most in (20, 10**6):
        shared = [rounds.answer_shared(pa.Table.from_batches([b]), most) for b in suffixes._anchors(group, none, 64).to_batches(1)]
        answers = pa.concat_tables([*shared, none.slice(0, 0)], promote_options="default")
        sent = suffixes._segments(group, answers, 64)
        anchors = np.concatenate([np.frombuffer(x, np.uint64) for x in sent.column("anchors").to_pylist()])
        largest[most] = np.unique(anchors, return_counts=True)[1].max()
    assert largest[20] <= 20 < 200 <= largest[10**6]
