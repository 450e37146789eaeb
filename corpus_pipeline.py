"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents with
benchmark passages go, sources are mixed to their target weights, and the rest is put into shards.

Every stage takes ``(spark, docs, sf_dir)`` and returns what it keeps of ``docs``; all but the last return the columns
of documents, the last adds ``shard`` and ``slot``.  A document that the mix takes twice is two rows from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galecast.llm import decontam, mixing, near_dup, sharding, toxicity
from galecast.llm.queries import held_out
from galecast.session import stage_table

#: Some stages learn from their input, so SQL can't express the pipeline; the tests hold it against a plain version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).where("tox_score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.where("bench_hits = 0").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, _table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated),
          ("mix", mix_sources), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
