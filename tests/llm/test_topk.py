import math
import random

import pytest
from pyspark.sql import functions as F

from galecast.llm import topk


def plain(rows, queries, k):
    out = {}
    for q, (qid, qv) in enumerate(queries):
        scores = sorted((-sum(x * y for x, y in zip(qv, v)), i) for i, v in rows if i != qid)
        out.setdefault(qid, []).append([(i, -s) for s, i in scores[:k]])
    return out


def test_quantised_drops_unsound_vectors(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [float("nan")]), (5, [float("inf")]), (6, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r["id"]: r["q"] for r in df.select("id", topk.quantised(F.col("v"), 256).alias("q")).collect()}
    assert got == {1: [128, math.floor(-0.001 * 256)], 2: None, 3: None, 4: None, 5: None, 6: []}


@pytest.mark.parametrize("block,scale", [(4096, 300), (3, 300), (4096, 1 << 30)])
def test_equals_brute_force(spark, block, scale):
    rng = random.Random(4)
    rows = [(i, [rng.randint(-scale, scale) for _ in range(rng.choice([12, 12, 12, 5, 0]))]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    queries = [r for r in rows if r[0] % 25 == 0]
    df = spark.createDataFrame([*rows, (None, [1]), (999, None)], "id long, vector array<long>").repartition(5)
    found = {}
    for r in topk.top_k(df, df.where("id % 25 = 0"), 5, block).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert found == {q: v[0] for q, v in plain(rows, queries, 5).items()}


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1, 2]), (50, [3, 4])], "id long, vector array<long>")
    got = topk.top_k(df, df, 5).select("query_id", "rank", "id", "score").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 50, 11), (50, 1, 0, 11)]
    assert topk.top_k(df.limit(0), df.limit(0), 5).collect() == []
