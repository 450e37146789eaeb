import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from galecast.llm import neural_lm
from galecast.llm.kernels import SPACED, Words, text_bytes
from . import cases

import pyarrow as pa


def learn():
    return F.col("doc_id") % 3 != 0


def is_training(doc_id):
    return doc_id is not None and doc_id % 3 != 0


def tokens(text):
    return [*cases.words(text, lower=True), None]


def group(word):
    words = Words(*text_bytes(pa.array([word])), SPACED, lower=True)
    return int(neural_lm.groups_of(words)[0])


def plain(rows, model, words):
    """Counts, base and score of every text, token by token."""
    count = Counter(t for r in rows if is_training(r[0]) for t in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    hashes = {w: int(Words(*text_bytes(pa.array([w])), SPACED, lower=True).hashes()[0]) for w in count if w is not None}
    top = sorted(hashes, key=lambda w: (-count[w], hashes[w]))[:words]
    output = {None: neural_lm.GROUPS, **{w: neural_lm.GROUPS + 1 + k for k, w in enumerate(top)}}
    held = Counter(), Counter()
    for w, c in count.items():
        if w not in output:
            held[0][group(w)] += c
            held[1][group(w)] += 1
    out = []
    for i, text, *_ in rows:
        base = score = 0.0
        before = [len(model.context) - 1] * neural_lm.CONTEXT
        for t in tokens(text):
            base += math.log10((count[t] + 1) / (n + v + 1))
            own = output[t] if t in output else group(t)
            x = sum(model.context[b].astype(float) * model.place[k] for k, b in enumerate(before))
            logits = model.output.astype(float) @ x + model.bias
            score += (logits[own] - np.log(np.exp(logits).sum())) / math.log(10)
            if t not in output:
                score += math.log10((count[t] + 1) / (held[0][own] + held[1][own] + 1))
            before = [own, *before[:-1]]
        out.append((i, len(tokens(text)), sum(count[t] > 0 for t in tokens(text)), n, base, score))
    return out


@pytest.mark.parametrize(("frequent", "clashing"), [(neural_lm.FREQUENT, False), (5, True), (0, False)])
def test_scores_equal_plain_ones(spark, monkeypatch, frequent, clashing):
    kept = {}
    train = neural_lm.train
    monkeypatch.setattr(neural_lm, "FREQUENT", frequent)
    monkeypatch.setattr(neural_lm, "vocabulary", lambda counts, f=neural_lm.vocabulary: f(counts, words=4, frequent=frequent))
    monkeypatch.setattr(neural_lm, "train", lambda *a: kept.setdefault("model", train(*a)))
    rows = cases.documents()
    got = neural_lm.score_texts(cases.frame(spark, rows, clashing), learn()).collect()
    words = len(kept["model"].output) - neural_lm.GROUPS - 1
    want = plain(rows, kept["model"], words)
    order = lambda r: (cases.rank(r[0]), r[1], r[4])
    got = sorted([(r["doc_id"], r["lm_tokens"], r["lm_known"], r["lm_train_tokens"], r["lm_base"], r["lm_score"]) for r in got], key=order)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-4)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    n = neural_lm.GROUPS + 6
    counts = np.arange(n)
    known = neural_lm.Vocabulary(np.zeros(0, np.uint64), counts[:0], counts[:0], counts[:256], counts[:256], counts, int(counts.sum()), n, 3)
    model = neural_lm.start(known)
    before = np.tile(rng.integers(0, n, (neural_lm.CONTEXT, 1)), (1, n))
    logs = neural_lm.log_probabilities(model, neural_lm.normalisers(model), neural_lm.Tokens(np.zeros(n, int), np.arange(n), before))
    assert (10 ** logs).sum() == pytest.approx(1, abs=1e-5)


def test_learns_what_follows_what(spark):
    """Texts that alternate between two words: a trained model knows the next word, single counts don't."""
    texts = [" ".join(["ping pong"] * 40), " ".join(["tick tock"] * 40)]
    rows = [(k, texts[k % 2], "en", "s", 0) for k in range(3000)]
    out = neural_lm.score_texts(cases.frame(spark, rows).repartition(4), learn()).agg(
        F.sum("lm_score").alias("model"), F.sum("lm_base").alias("base"), F.sum("lm_tokens").alias("n")).first()
    assert out["model"] / out["n"] > 0.5 * out["base"] / out["n"]


def test_empty_table_and_nothing_to_learn_from(spark):
    assert neural_lm.score_texts(spark.createDataFrame([], cases.SCHEMA), learn()).collect() == []
    out = neural_lm.score_texts(cases.frame(spark, [(3, "a b", "en", "s", 3), (None, None, None, None, None)]), learn()).collect()
    assert [(r["lm_tokens"], r["lm_known"], r["lm_train_tokens"], r["lm_base"]) for r in sorted(out, key=lambda r: r["lm_tokens"])] == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(r["lm_score"] < 0 for r in out)
