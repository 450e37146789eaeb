"""Small awkward inputs and plain versions of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(seed=1, n=60, words=40, vocabulary=30):
    """Texts with copies, near copies, shared passages, nulls, empties, a long text and repeated rows."""
    rng = random.Random(seed)
    vocab = [w for w in ("".join(rng.choice("abéñ日xyz") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary))]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    texts = []
    for i in range(n):
        t = [rng.choice(vocab) for _ in range(rng.randint(1, words))]
        kind = i % 6
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
            continue
        if kind == 2:
            t = t[:5] + passage.split() + t[5:]
        if kind == 3 and texts:
            t = rng.choice(texts).split()
            if t:
                t[rng.randrange(len(t))] = "CHANGED"
        texts.append(rng.choice([" ", "\n", "\t "]).join(t))
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, texts[0]), (n + 3, " ".join(rng.choice(vocab) for _ in range(3000))),
             rows[0], rows[0]]
    return [(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or "")) for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as further columns of a table.
CLASHING = ("node", "bucket", "size", "key", "u", "v", "label", "target", "grp", "term", "score")


def frame(spark, rows, clashing=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F
        for name in CLASHING:
            df = df.withColumn(name, F.lit(1))
    return df


def words(text, pattern=WORD, lower=False):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def rank(doc_id):
    return float("inf") if doc_id is None else doc_id
