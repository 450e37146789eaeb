"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the edge table, so a node with a
third of all edges is pre-aggregated in the first and split by adaptive
execution in the second.  Edges are staged between rounds, which also cuts the
lineage.  Ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage_table


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of ``edges`` (``u``, ``v``: long); the label is the smallest node reachable."""
    edges = stage_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "edges", small=True)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = stage_table(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                         F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
                            .where("u <> v").distinct(), "edges", small=True)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
