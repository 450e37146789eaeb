"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Tokens are the words of a text (``A-Z`` lowered) and one end.  The model
predicts *outputs*: the end, the ``words`` most frequent words each by itself, and
``GROUPS`` groups of all other words, by their last two bytes.  A context is the
``CONTEXT`` outputs before; its vector is the sum of their vectors, each scaled by
a vector of its place, and an output's score the product with the output's own
vector plus a bias (Mnih and Hinton).  A word in a group has the group's
probability times its add-one share of the group, where one more event stands
for all words that training never saw; so the probabilities of all events
sum to 1 after every context.

Counts are over all training texts: each task counts the words of its batches
and Spark adds the counts up.  Training reads every training text once, in
``ROUNDS`` of growing size.  In a round every task starts from the same model, takes Adagrad
steps on batches of its own texts (numpy; the noise of a batch is drawn once
from the unigram distribution of the outputs and shared by its tokens, so both
sides are matrix products), and the tasks' models are averaged in two levels by
tokens.  Only the averaged model and the ``FREQUENT`` most frequent words (16
bytes each) visit the driver.  Scores are exact: the normaliser is the sum
over all outputs.  Contexts of ``CONTEXT`` outputs are few enough to have theirs in a table, which one
matrix product for each nearest output fills.

A text's words that are not among the frequent ones are joined to the counts by
the word itself.  Frequent words are recognised by a 64-bit hash.

Defined results.  Null text is empty: one token, the end.  Rows without an id
learn or not as the caller's condition says (null: not).  Equal rows
count as often as they occur and get equal scores.  Without training texts every
count is 0 and the model is the start.  Other columns but ``text`` are kept and
may have any name but those that begin with ``lm_``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import drop_staged, stage_table
from .kernels import SPACED, Words, mix, ragged, row_slices, sums_by, text_bytes
from .rounds import find

GROUPS, WORDS, SIZE, CONTEXT = 256, 255, 16, 2
FREQUENT = 1 << 18
ROUNDS = (1 / 8, 1.0)
BATCH, NOISE, RATE = 512, 64, 0.2
_COUNT_BYTES = 2 << 20
_END = GROUPS


@dataclass(frozen=True)
class Vocabulary:
    """Frequent words by hash (sorted) with their counts and outputs (-1: in a group), and what is in the groups."""

    hashes: np.ndarray
    counts: np.ndarray
    outputs: np.ndarray
    group_tokens: np.ndarray
    group_words: np.ndarray
    output_tokens: np.ndarray
    tokens: int
    distinct: int
    texts: int

    @property
    def noise(self) -> np.ndarray:
        share = self.output_tokens + 1.0
        return share / share.sum()


@dataclass(frozen=True)
class Model:
    context: np.ndarray   # a vector for each output, and one for what is before a text
    place: np.ndarray     # a vector for each place in a context
    output: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in (self.context, self.place, self.output, self.bias)])

    def filled(self, flat: np.ndarray) -> Model:
        parts, at = [], 0
        for x in (self.context, self.place, self.output, self.bias):
            parts.append(flat[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*parts)


def start(vocabulary: Vocabulary, size: int = SIZE, seed: int = 1) -> Model:
    rng, n = np.random.default_rng(seed), len(vocabulary.output_tokens)
    draw = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
    return Model(draw(n + 1, size), np.ones((CONTEXT, size), np.float32), draw(n, size), np.log(vocabulary.noise).astype(np.float32))


def groups_of(words: Words) -> np.ndarray:
    """The group that each word would be in, by its last two bytes."""
    last = words.norm[words.end - 1].astype(np.uint64)
    before = np.where(words.end - words.start > 1, words.norm[np.maximum(words.end - 2, 0)], 0).astype(np.uint64)
    return (mix((before << np.uint64(8) | last) + np.uint64(1)) % np.uint64(GROUPS)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        for lo, n in row_slices(text, *([limit] if limit else [])):
            part = batch.slice(lo, n)
            yield part, Words(*text_bytes(text.slice(lo, n)), SPACED, lower=True)


def _strings(words: Words, at: np.ndarray) -> pa.Array:
    """The words at the given numbers, as an Arrow array."""
    size = words.end[at] - words.start[at]
    data = words.norm[ragged(words.start[at], size)[0]]
    ends = np.concatenate([[0], np.cumsum(size)])
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, hash, grp, n)`` of each stretch of texts; the row without a word counts the texts."""
    texts = 0
    for part, words in _slices(batches, _COUNT_BYTES):
        texts += len(part)
        own, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
        grp = groups_of(words)[first]
        for at in np.array_split(np.arange(len(own)), max(1, len(own) // 50_000)):
            yield pa.RecordBatch.from_arrays([_strings(words, first[at]), pa.array(own[at].view(np.int64)),
                                              pa.array(grp[at], pa.int32()), pa.array(n[at], pa.int64())],
                                             ["word", "hash", "grp", "n"])
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([-1], pa.int32()),
                                          pa.array([texts], pa.int64())], ["word", "hash", "grp", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """Staged ``(word, hash, grp, n)`` of all texts of ``docs``."""
    rows = docs.select("text").mapInArrow(_count, "word string, hash long, grp int, n long")
    total = rows.groupBy("word").agg(F.first("hash").alias("hash"), F.first("grp").alias("grp"), F.sum("n").alias("n"))
    return stage_table(total, "lm-counts")


def vocabulary(counts: DataFrame, words: int = WORDS, frequent: int = FREQUENT) -> tuple[Vocabulary, int]:
    """What the tasks know of all words, and the least count of a frequent one."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int").alias("level")
    known = counts.where("word IS NOT NULL")
    levels = sorted(known.groupBy(level).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), reverse=True)
    held, least = 0, 0
    for r in levels:  # a few hundred at most
        held += r["words"]
        if held > frequent:
            break
        least = r["least"]
    # At most ``frequent`` rows of numbers.
    top = known.where(F.col("n") >= (least or (1 << 62))).select("hash", "n", "grp").toArrow()
    hashes, n, grp = (top.column(c).to_numpy() for c in ("hash", "n", "grp"))
    order = np.argsort(hashes.view(np.uint64))
    hashes, n, grp = hashes.view(np.uint64)[order], n[order], grp[order]
    outputs = np.full(len(n), -1, np.int64)
    own = np.lexsort((hashes, -n))[:words]
    outputs[own] = _END + 1 + np.arange(len(own))
    group_tokens, group_words = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    texts = 0
    for r in counts.groupBy("grp").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():  # GROUPS + 1 rows
        if r["grp"] < 0:
            texts = r["n"]
        else:
            group_tokens[r["grp"]], group_words[r["grp"]] = r["n"], r["words"]
    tokens, distinct = int(group_tokens.sum()) + texts, int(group_words.sum()) + (texts > 0)
    np.subtract.at(group_tokens, grp[own], n[own])
    np.subtract.at(group_words, grp[own], 1)
    return Vocabulary(hashes, n, outputs, group_tokens, group_words, np.concatenate([group_tokens, [texts], n[own]]),
                      tokens, distinct, texts), int(least)


@dataclass(frozen=True)
class Tokens:
    """Outputs of consecutive texts with ends, and the outputs before each token, the nearest first."""

    of_text: np.ndarray
    output: np.ndarray
    before: np.ndarray

    @staticmethod
    def read(words: Words, outputs: np.ndarray, pad: int) -> Tokens:
        texts, n = len(words.first) - 1, len(words)
        # Every text is its words, its end and the places before the next.
        of = words.of_text()
        at = np.arange(n) + (CONTEXT + 1) * of + CONTEXT
        ends = words.first[1:] + (CONTEXT + 1) * np.arange(texts) + CONTEXT
        sequence = np.full(n + (CONTEXT + 1) * texts + CONTEXT, pad, np.int64)
        sequence[at] = outputs
        sequence[ends] = _END
        place = np.concatenate([at, ends])
        return Tokens(np.concatenate([of, np.arange(texts)]), sequence[place], np.stack([sequence[place - k] for k in range(1, CONTEXT + 1)]))


def _outputs(words: Words, hashes: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The output of each word, whether it is a frequent one, and its place among them."""
    frequent, at = find(hashes, known.hashes)
    own = np.where(frequent, known.outputs[at] if len(known.outputs) else -1, -1)
    return np.where(own >= 0, own, groups_of(words)), frequent, at


class Trainer:
    """Adagrad on the noise-contrastive objective."""

    def __init__(self, model: Model, noise: np.ndarray, rate: float, seed: int):
        self.model, self.rate, self.rng = replace(model, **{k: v.copy() for k, v in vars(model).items()}), rate, np.random.default_rng(seed)
        self.squares = {k: np.full_like(v, 1e-2) for k, v in vars(model).items()}
        self.upto = np.cumsum(noise)
        self.offset = (np.log(noise) + math.log(NOISE)).astype(np.float32)

    def _sum_rows(self, at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
        size = values.shape[1]
        flat = (at[:, None] * size + np.arange(size)).reshape(-1)
        return np.bincount(flat, values.reshape(-1), rows * size).reshape(rows, size).astype(np.float32)

    def step(self, target: np.ndarray, before: np.ndarray) -> None:
        m, n = self.model, len(target)
        noise = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), len(self.upto) - 1)
        near = m.context[before]
        x = np.einsum("kbd,kd->bd", near, m.place)
        own = m.output[target]
        sure = 1 / (1 + np.exp(np.einsum("bd,bd->b", x, own) + m.bias[target] - self.offset[target]))
        wrong = -1 / (1 + np.exp(-(x @ m.output[noise].T + m.bias[noise] - self.offset[noise])))
        step = sure[:, None] * own + wrong @ m.output[noise]
        outputs = self._sum_rows(target, sure[:, None] * x, len(m.output))
        bias = np.bincount(target, sure, len(m.bias)).astype(np.float32)
        np.add.at(outputs, noise, wrong.T @ x)
        np.add.at(bias, noise, wrong.sum(axis=0))
        context = np.zeros_like(m.context)
        for k in range(CONTEXT):
            context += self._sum_rows(before[k], step * m.place[k], len(context))
        place = np.einsum("bd,kbd->kd", step, near)
        for name, grad in (("context", context), ("place", place), ("output", outputs), ("bias", bias)):
            grad /= n
            self.squares[name] += grad * grad
            getattr(m, name).__iadd__(self.rate * grad / np.sqrt(self.squares[name]))

    def learn(self, tokens: Tokens) -> int:
        order = self.rng.permutation(len(tokens.output))
        for lo in range(0, len(order), BATCH):
            at = order[lo:lo + BATCH]
            self.step(tokens.output[at], tokens.before[:, at])
        return len(order)


def _trained(known, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known, model = known.value
        part = TaskContext.get().partitionId()
        trainer, seen = Trainer(model, words_known.noise, rate, seed * 1_000_003 + part), 0
        for _, words in _slices(batches):
            seen += trainer.learn(Tokens.read(words, _outputs(words, words.hashes(), words_known)[0], len(words_known.output_tokens)))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seen], pa.int64()),
                                              pa.array([trainer.model.flat().astype(np.float32).tobytes()], pa.binary())],
                                             ["part", "tokens", "model"])
    return run


def _averaged(models: pa.Table) -> pa.Table:
    models = models.sort_by("part")
    weight = models.column("tokens").to_numpy().astype(float)
    total = sum(w * np.frombuffer(x, np.float32).astype(float) for w, x in zip(weight, models.column("model").to_pylist(), strict=True))
    return pa.table({"part": pa.array([models.column("part")[0].as_py()], pa.int64()), "tokens": pa.array([int(weight.sum())], pa.int64()),
                     "model": pa.array([(total / weight.sum()).astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, known: Vocabulary, rounds=ROUNDS, rate: float = RATE) -> Model:
    """One pass over ``docs`` in parts; after each the tasks' models are averaged."""
    spark, model = docs.sparkSession, start(known)
    place = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / (1 << 20))
    ways = max(1, math.isqrt(docs.rdd.getNumPartitions()))
    schema, before = "part long, tokens long, model binary", 0.0
    for k, upto in enumerate(rounds):
        share = docs.where((place >= before) & (place < upto)).select("text")
        found = share.mapInArrow(_trained(spark.sparkContext.broadcast((known, model)), rate, k), schema)
        found = found.groupBy(F.pmod("part", F.lit(ways)).alias("way")).applyInArrow(_averaged, schema)
        last = found.groupBy(F.lit(0).alias("one")).applyInArrow(_averaged, schema).collect()  # at most one model
        if last:
            model = model.filled(np.frombuffer(last[0]["model"], np.float32))
        before = upto
    return model


def normalisers(model: Model) -> np.ndarray:
    """The logarithm of the sum over all outputs after every context: one matrix product for each nearest output."""
    vectors, n = np.ascontiguousarray(model.output.T), len(model.context)
    out = np.empty((n, n))
    farther = model.context * model.place[1]
    for nearest in range(n):
        scores = (farther + model.context[nearest] * model.place[0]) @ vectors + model.bias
        most = scores.max(axis=1, keepdims=True)
        out[nearest] = np.log(np.exp(scores - most).sum(axis=1, dtype=float)) + most[:, 0]
    return out


def log_probabilities(model: Model, table: np.ndarray, tokens: Tokens) -> np.ndarray:
    """log10 of each token's output after its context, normalised over all outputs; ``table`` has the normalisers."""
    near, far = tokens.before
    vector = model.context[near] * model.place[0]
    vector += model.context[far] * model.place[1]
    scores = np.einsum("bd,bd->b", vector, model.output[tokens.output]) + model.bias[tokens.output]
    return (scores - table[near, far]) / math.log(10)


_PARTS = T.StructType([
    T.StructField("lm_tokens", T.LongType()), T.StructField("lm_known", T.LongType()), T.StructField("lm_base", T.DoubleType()),
    T.StructField("lm_score", T.DoubleType()), T.StructField("lm_rare", T.ArrayType(T.StringType())),
    T.StructField("lm_times", T.ArrayType(T.LongType()))])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model, table = shared.value
        every = math.log10(known.tokens + known.distinct + 1)
        in_group = np.log10(known.group_tokens + known.group_words + 1.0)
        logs = np.log10(known.counts + 1.0)
        for part, words in _slices(batches):
            n = len(part)
            hashes = words.hashes()
            output, frequent, at = _outputs(words, hashes, known)
            tokens = Tokens.read(words, output, len(known.output_tokens))
            score = np.bincount(tokens.of_text, log_probabilities(model, table, tokens), n)
            of, grouped = words.of_text(), output < GROUPS
            gained = np.where(frequent, logs[at] if len(logs) else 0.0, 0.0)
            base = np.bincount(of, gained, n) + math.log10(known.texts + 1) - every * (words.counts() + 1)
            score += np.bincount(of[grouped], (gained - in_group[np.minimum(output, GROUPS - 1)])[grouped], n)
            # Words that are not frequent, each once a text with its number there.
            rare = np.flatnonzero(~frequent)
            order = rare[np.lexsort((hashes[rare], of[rare]))]
            key = np.stack([of[order].astype(np.uint64), hashes[order]])
            first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if len(order) else order
            times = np.diff(np.concatenate([first, [len(order)]]))
            held = np.bincount(of[order[first]], minlength=n) if len(order) else np.zeros(n, np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
            new = [pa.array(words.counts() + 1, pa.int64()),
                   pa.array(sums_by(words.first, frequent.astype(np.int64)) + (known.texts > 0), pa.int64()), pa.array(base), pa.array(score),
                   pa.ListArray.from_arrays(ends, _strings(words, order[first])),
                   pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))]
            keep = [k for k, name in enumerate(part.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *new],
                                             [*[part.schema.names[k] for k in keep], *_PARTS.names])
    return run


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """``docs`` without ``text``, plus ``lm_tokens``, ``lm_known`` (tokens that training has), ``lm_train_tokens``,
    ``lm_base`` (log10 by add-one unigrams) and ``lm_score`` (log10 by the model).  ``learn`` says which rows train."""
    spark = docs.sparkSession
    training = docs.where(F.coalesce(learn, F.lit(False))).select("doc_id", "text")
    counts = count_words(training)
    known, least = vocabulary(counts)
    model = train(training, known)
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != "text"], *_PARTS.fields])
    # Numbers of the model's size and the frequent words', whatever the corpus.
    parts = docs.mapInArrow(_scored(spark.sparkContext.broadcast((known, model, normalisers(model)))), schema)
    parts = stage_table(parts.withColumn("lm_row", F.monotonically_increasing_id()), "lm-parts")
    rare = parts.select("lm_row", F.explode(F.arrays_zip(F.col("lm_rare").alias("word"), F.col("lm_times").alias("times"))).alias("r"))
    rare = rare.select("lm_row", "r.word", "r.times")
    others = counts.where("word IS NOT NULL").where(F.col("n") < (least or (1 << 62))).select("word", "n")
    gained = rare.join(others, "word").groupBy("lm_row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("lm_gained"), F.sum("times").alias("lm_found"))
    gained = stage_table(gained, "lm-rare")
    drop_staged(counts)
    whole = parts.drop("lm_rare", "lm_times").join(gained, "lm_row", "left").withColumn(
        "lm_gained", F.coalesce("lm_gained", F.lit(0.0)))
    kept = [c for c in docs.columns if c != "text"]
    return whole.select(*kept, "lm_tokens", (F.col("lm_known") + F.coalesce("lm_found", F.lit(0))).alias("lm_known"),
                        F.lit(known.tokens).cast("long").alias("lm_train_tokens"),
                        (F.col("lm_base") + F.col("lm_gained")).alias("lm_base"),
                        (F.col("lm_score") + F.col("lm_gained")).alias("lm_score"))
