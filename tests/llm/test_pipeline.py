"""Each stage on its predecessor's result, against plain versions."""

from collections import Counter

import pyarrow.parquet as pq

import corpus_pipeline
from galecast.llm import toxicity
from galecast.llm.queries import held_out
from galecast.session import stage_table
from pyspark.sql import functions as F

from . import cases
from .test_decontam import plain as hits
from .test_near_dup import plain as near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = (before, docs) = (docs, stage_table(stage(spark, docs, SF), "test-pipeline"))
        assert docs.columns == (columns if name != "shard" else [*columns, "shard", "slot"])

    before, after = kept["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out(F.col("doc_id"))))
    good = {r["doc_id"] for r in toxicity.score(before, model).where("tox_score < 0.5").collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(good)

    before, after = kept["near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({r[0] for r in near(rows, 5, 80) if r[3]})

    before, after = kept["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    clean = [r["doc_id"] for r in before.collect() if not hits(r["text"], items)[1]]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(clean)

    before, after = kept["mix"]
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    assert max(r["count"] for r in after.groupBy("doc_id").count().collect()) <= 2

    before, after = kept["shard"]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in before.collect())
    slots = {}
    for r in after.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 0


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns; then no rows at all."""
    docs = cases.frame(spark, [*cases.documents(n=30), (None, None, None, None, None), (None, None, None, None, None)], clashing=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", None), ("b", ""), (None, "x y")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for start in (whole, whole.where("false")):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage_table(stage(spark, docs, str(tmp_path)), "test-awkward")
            assert docs.columns == (whole.columns if name != "shard" else [*whole.columns, "shard", "slot"])
            known = Counter(map(repr, before.collect()))
            if name in ("toxicity", "near_dedup", "decontaminate"):  # what stays is what came
                assert not Counter(map(repr, docs.collect())) - known
            if start is not whole:
                assert docs.count() == 0
