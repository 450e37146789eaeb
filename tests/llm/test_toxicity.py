import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from galecast.llm import toxicity
from . import cases


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        t = ["".join(rng.choice(["ta", "ri", "no", "shel", "dé"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            t.insert(rng.randrange(len(t)), rng.choice(["Grumbach", "vexatious"]))
        rows.append((i, " ".join(t), "en", "a", 1))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    rows += [(1000, None, "en", "a", 1), (1001, "", "en", "a", 1), (1002, "x", "en", "a", 1), (1003, "ta " * 60_000 + "GRUMBACH", "en", "a", 1),
             (None, "vexatious", "en", "a", 1)]
    docs = cases.frame(spark, rows, clashing=True)
    known = spark.createDataFrame([x for x in labels if x[0] % 5] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "tox_score"]
    score = {r["doc_id"]: r["tox_score"] for r in out.collect()}
    assert all(0 <= s <= 1 for s in score.values()) and len(score) == len(rows)
    wrong = [i for i, y in labels if i % 5 == 0 and (score[i] >= 0.5) != bool(y)]
    assert len(wrong) <= 2, wrong
    assert score[1000] == score[1001] == score[1002] < 0.5 < min(score[1003], score[None])


def test_without_both_labels_the_score_is_the_share(spark):
    docs = cases.frame(spark, corpus(20)[0])
    for rows, share in (([], 0.5 / 2), ([(1, 1), (2, 1)], 2.5 / 4)):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {round(r["tox_score"], 9) for r in toxicity.score(docs, model).collect()} == {round(share, 9)}
    assert toxicity.score(cases.frame(spark, []), model).collect() == []


def test_a_wide_vocabulary_is_learnt(spark):
    """400 toxic words, each in few texts: a cap of 1,024 slots leaves most of them out (0.68 right)."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    plain, bad = [word() for _ in range(3000)], [word() for _ in range(400)]
    rows, labels = [], []
    for i in range(4000):
        t = [rng.choice(plain) for _ in range(rng.randint(10, 40))]
        if i % 2:
            t[rng.randrange(len(t))] = rng.choice(bad)
        rows.append((i, " ".join(t), "en", "a", 1))
        labels.append((i, i % 2))
    docs = cases.frame(spark, rows)
    known = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    model = toxicity.train(docs, known, penalties=[1e-3, 10.0])  # the second learns nothing and must lose
    score = {r["doc_id"]: r["tox_score"] for r in toxicity.score(docs, model).where("doc_id % 5 = 0").collect()}
    right = [(score[i] >= 0.5) == bool(y) for i, y in labels if i % 5 == 0]
    assert sum(right) >= 0.77 * len(right)


def test_ratios_and_fit_equal_plain_ones(spark):
    rows, labels = corpus(120, seed=4)
    docs = cases.frame(spark, rows)
    slots_of = lambda t: set(toxicity._slots(pa.array([t]))[1].tolist())
    by_text = {}
    for i, t, *_ in rows:
        low = t.lower()
        by_text[i] = set().union(*[slots_of(low[k:k + n]) for n in toxicity.SIZES for k in range(len(low) - n + 1)])
        assert by_text[i] == slots_of(t)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), penalties=[0.01])
    y = np.array([v for _, v in labels], float)
    n1, n0 = y.sum(), (1 - y).sum()
    a, b = Counter(), Counter()
    for i, v in labels:
        (a if v else b).update(by_text[i])

    def gained(s):
        cells = [(a[s], (a[s] + b[s]) * n1), (b[s], (a[s] + b[s]) * n0), (n1 - a[s], (n1 + n0 - a[s] - b[s]) * n1), (n0 - b[s], (n1 + n0 - a[s] - b[s]) * n0)]
        return 2 * sum(x * math.log(x * (n1 + n0) / e) for x, e in cells if x)

    want = sorted(s for s in set(a) | set(b) if gained(s) >= toxicity.STRENGTH)
    assert model.slots.tolist() == want and len(want) > 20
    ratio = np.array([math.log(((a[s] + 1) / (n1 + 1)) / ((b[s] + 1) / (n0 + 1))) for s in want])
    X = np.array([[s in by_text[i] for s in want] for i, _ in labels], float) * ratio
    w, intercept = model.weights / ratio, model.intercept - math.log((n1 + 0.5) / (n0 + 1.5)) + math.log(n1 / n0)
    gap = 1 / (1 + np.exp(-(X @ w + intercept))) - y
    # The gradient of the penalised loss is zero.
    assert np.abs(X.T @ gap / len(y) + 0.01 * w).max() < 1e-3 and abs(gap.mean()) < 1e-3
