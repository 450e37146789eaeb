import random

import numpy as np

from galecast.llm import near_dup
from galecast.llm.components import components
from . import cases


def shingles(text, n):
    w = cases.words(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[p:p + n]) for p in range(max(1, len(w) - n + 1)))


def plain(rows, n, percent):
    sets = [shingles(t, n) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), float("inf")), cases.rank(doc))
    out = []
    for i, (doc, *_) in enumerate(rows):
        own = least[find(i)]
        own = None if own == float("inf") else own
        out.append((doc, len(sets[i]), doc if not sets[i] else own, (doc if not sets[i] else own) == doc))
    return out


def family(n=120, seed=5):
    """Copies of one text with a few changed words, most of which link to the original only."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(t), "en", "a", 1))
    return rows


def test_components_equal_brute_force(spark):
    for words in (4, 5):
        rows = cases.documents(8, 60, words=60) + family()
        got = near_dup.near_duplicates(cases.frame(spark, rows, clashing=True), words=words, percent=80).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows, words, 80)))


def test_drop_keeps_one_of_each_group(spark):
    rows = cases.documents(9, 50, words=60)
    docs = cases.frame(spark, rows, clashing=True)
    out = near_dup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    known = plain(rows, 5, 80)
    want = {r[2] for r in known if r[1]}
    kept = out.collect()
    assert sorted(r["doc_id"] for r in kept if cases.words(r["text"])) == sorted(want)
    assert sum(not cases.words(r["text"]) for r in kept) == sum(not r[1] for r in known)


def test_empty_table(spark):
    assert near_dup.near_duplicates(cases.frame(spark, [])).collect() == []


def test_odd_sketches_tell_similarities_apart():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for j, near in ((0.8, True), (0.9, True), (0.6, False), (0.3, False)):
        both = int(1000 * 2 * j / (1 + j))
        a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[:both], pool[1500:2500 - both]]))
        x, y = near_dup.odd_sketches([a, b]).view(np.uint64)
        assert (int(np.bitwise_count(x ^ y).sum()) <= near_dup.odd_limit(80)) == near


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(500, 560)] \
        + [(900, 901 + i) for i in range(50)] + [(3, 3)]
    label = {x: x for e in edges for x in e}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in label)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_drop_keeps_one_where_the_smallest_id_is_null_or_shared(spark):
    rng = random.Random(11)
    rows, texts = [], []
    for ids in ((None, None, None), (7, 7, 9), (7, 7, 7), (None, 8, 8)):
        base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
        for k, i in enumerate(ids):
            texts.append(" ".join(base[:-1] + [f"end{k}"]))
            rows.append((i, texts[-1], "en", "a", 1))
    rows.append(rows[0])
    out = near_dup.drop_near_duplicates(cases.frame(spark, rows, clashing=True)).collect()
    groups = sorted(texts.index(r["text"]) // 3 for r in out)
    assert groups == [0, 1, 2, 3]
    assert sorted((texts.index(r["text"]) // 3, r["doc_id"]) for r in out if r["doc_id"]) == [(1, 7), (2, 7), (3, 8)]


def test_pairs_at_the_threshold_are_lost_with_a_chance_below_a_ten_millionth():
    assert (1 - 0.8 ** near_dup.ROWS) ** near_dup.BANDS <= (1 - 0.8 ** 4) ** 32 < 1e-7
    assert near_dup.SIGMAS >= 6 and near_dup.odd_limit(80) >= near_dup.odd_limit(80, 6.0)
