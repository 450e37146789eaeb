"""Exact top-k by inner product with MaxScore.

Vectors are lists of integers; a dimension is a query term and its values over
the vectors of a shard are its postings.  Over a shard, term d adds to a
query's score something between its least and its greatest product, so a score
is the sum of the least products plus non-negative contributions.  Terms are
ordered by the width of that range.  Those whose widths together cannot lift a
vector to the query's current k-th best score are non-essential: the essential
postings are traversed for all vectors of the shard, and the others are probed,
widest first, only for vectors whose partial score plus the widths still to
come is competitive.  Ties stay competitive, as a smaller id may win them.

Queries are a stated set and are taken in blocks of ``QUERY_BLOCK``, each
broadcast and run against all rows; every partition keeps k results a query,
and a ranked merge of the partitions gives the answer.

Defined results.  Rows without an id, and vectors that are null or hold null
or non-finite components, take no part.  A shorter vector counts as filled up
with zeros; an empty one scores 0.  A query is never its own candidate, nor are
rows that share its id; a repeated query row is answered once for each row.
Scores are exact for 64-bit sums; components beyond 64 bits are cut to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

SHARD, QUERY_BLOCK, PROBE = 4096, 4096, 8


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component, or null if one is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(sound, F.lit(False)),
                  F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long")))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` components; the kind of number is the fastest that keeps sums exact."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.repeat(np.arange(len(vectors)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = \
        vectors.flatten().to_numpy(zero_copy_only=False)
    return out


class Queries:
    def __init__(self, rows: list[tuple[int, int, list[int]]], k: int):
        self.k, self.number = k, np.array([r[0] for r in rows], np.int64)
        self.ids = np.array([r[1] for r in rows], np.int64)
        self.width = max([len(r[2]) for r in rows], default=0)
        self.vectors = _matrix(pa.array([r[2] for r in rows], pa.list_(pa.int64())), self.width)


class Best:
    """The k best of each query so far."""

    def __init__(self, queries: Queries):
        self.queries = queries
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries.ids)
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries.ids)

    def add_shard(self, ids: np.ndarray, shard: np.ndarray) -> None:
        q, k = self.queries, self.queries.k
        small = float(np.abs(shard).max(initial=0)) * float(np.abs(q.vectors).max(initial=0)) * max(1, q.width) < 2.0 ** 53
        kind = np.float64 if small else np.int64
        lists = np.ascontiguousarray(shard.T).astype(kind)
        low, high = lists.min(axis=1, initial=np.inf if small else None) if small else lists.min(axis=1), lists.max(axis=1)
        for i, vector in enumerate(q.vectors.astype(kind)):
            ends = np.stack([vector * low, vector * high])
            least, widest = ends.min(axis=0), ends.max(axis=0) - ends.min(axis=0)
            order = np.argsort(-widest, kind="stable")
            rest = np.append(np.cumsum(widest[order][::-1])[::-1], 0)  # widths of a term and all after it
            base = least.sum()
            bar = self.scores[i][-1] if len(self.scores[i]) == k else None
            essential = len(order) if bar is None else int(np.argmax(base + rest < bar)) if (base + rest < bar).any() else len(order)
            lead = order[:essential]
            partial = base - least[lead].sum() + vector[lead] @ lists[lead]
            alive = np.arange(len(ids)) if bar is None else np.flatnonzero(partial + rest[essential] >= bar)
            partial = partial[alive]
            for at in range(essential, len(order), PROBE):
                if not len(alive):
                    break
                terms = order[at:at + PROBE]
                partial = partial - least[terms].sum() + vector[terms] @ lists[np.ix_(terms, alive)]
                on = partial + rest[min(at + PROBE, len(order))] >= bar
                alive, partial = alive[on], partial[on]
            self._keep(i, ids[alive], partial.astype(np.int64))

    def _keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        on = ids != self.queries.ids[i]
        ids, scores = np.concatenate([self.ids[i], ids[on]]), np.concatenate([self.scores[i], scores[on]])
        if len(scores) > 4 * self.queries.k:
            bar = np.partition(scores, len(scores) - self.queries.k)[len(scores) - self.queries.k]
            ids, scores = ids[scores >= bar], scores[scores >= bar]
        best = np.lexsort((ids, -scores))[:self.queries.k]
        self.ids[i], self.scores[i] = ids[best], scores[best]


def _search(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = known.value
        best = Best(queries)
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                size = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                shard = _matrix(part.column(1), int(max(size.max(initial=0), queries.width)))[:, :queries.width]
                best.add_shard(part.column(0).to_numpy(), shard)
        counts = [len(x) for x in best.ids]
        flat = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(queries.number, counts)), pa.array(np.repeat(queries.ids, counts)), pa.array(flat(best.ids)),
             pa.array(flat(best.scores))], ["query", "query_id", "id", "score"])
    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``rows`` and ``queries`` hold ``id`` (long) and ``vector`` (array of long).

    Gives ``query, query_id, rank, id, score``: up to k rows for each query row, ``query`` its number.
    """
    spark = rows.sparkSession
    rows = rows.select("id", "vector").where("id IS NOT NULL AND vector IS NOT NULL")
    held: list[tuple[int, int, list[int]]] = []
    parts: list[DataFrame] = []

    def search() -> None:
        known = spark.sparkContext.broadcast(Queries(held, k))
        parts.append(rows.mapInArrow(_search(known), "query long, query_id long, id long, score long"))
        held.clear()

    for number, q in enumerate(queries.select("id", "vector").where("id IS NOT NULL AND vector IS NOT NULL").toLocalIterator()):
        held.append((number, q["id"], list(q["vector"])))
        if len(held) == block:
            search()
    if held or not parts:
        search()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
