"""The registered queries ``opN_<name>``: each applies its operator, with
production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, divergence, infill, licenses, mixing, near_dup, neural_lm, pii, sharding, substrings, suffixes, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_digest(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.filter("bench_items", lambda x: x.isNotNull())), ",")
    return found.select("doc_id", F.col("bench_words").alias("n_words"), F.col("bench_hits").alias("n_hit"),
                        F.size("bench_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
                        (F.col("bench_hits") > 0).alias("contaminated"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.get("lic_found", F.lit(0))
    return found.select("doc_id", F.col("lic_words").alias("n_words"), F.size("lic_found").cast("long").alias("n_licenses"),
                        best["license"].alias("license"), F.round(best["coverage"], 6).alias("coverage"),
                        best["matched"].alias("n_matched"), best["first_word"].alias("first_word"),
                        best["last_word"].alias("last_word"))


def held_out(doc_id):
    """Every fifth id by its CRC: no label of these rows is learnt."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    terms = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
                        pii.joined(F.concat("base", terms)).alias("spans"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), topk.quantised(F.col("embedding"), 256).alias("vector"))
    found = topk.top_k(rows, rows.where("id % 50 = 0"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeated_words(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    rows = neural_lm.score_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), remainder != 2)
    return rows.select("doc_id", (remainder == 2).alias("held_out"), F.col("lm_tokens").alias("n_tokens"),
                       F.col("lm_known").alias("n_known"), F.col("lm_train_tokens").alias("train_tokens"),
                       F.col("lm_base").alias("base_score"), F.col("lm_score").alias("score"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = infill.restore(F.col("fim_output"), F.col("fim_form"))
    return rows.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"),
                       F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
                       F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def llm_queries() -> dict[str, Query]:
    return {"op1_mix": op1_mix, "op2_shard": op2_shard, "op3_decontaminate": op3_decontaminate,
            "op4_license_scan": op4_license_scan, "op5_toxicity": op5_toxicity,
            "op6_pii": op6_pii, "op7_suffix_dedup": op7_suffix_dedup, "op8_topk": op8_topk, "op9_substring_dedup": op9_substring_dedup,
            "op10_near_dedup": op10_near_dedup, "op11_lm_score": op11_lm_score, "op12_divergence": op12_divergence, "op13_infill": op13_infill}
