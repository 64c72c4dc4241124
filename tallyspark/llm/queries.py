"""The registered queries opN_<name> over the whole tables; each derives its digest columns from its operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import ann, archives, bytebpe, dedup, licenses, middle, packing, periodic, privacy, quality, sharding, toxicity, urls
from tallyspark.llm.common import shared_dir, table


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.line_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("left_share", 6).alias("left_share"), F.size("removed").cast("long").alias("n_removed_lines"))


def op7_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.with_slots(sharding.kd_shards(table(spark, sf_dir, "documents"), shards=16))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op8_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = labels.filter("toxic IS NOT NULL OR quality IS NOT NULL").select("doc_id", F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    found = urls.judge(table(spark, sf_dir, "pages"), bad)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", F.round("bad_share", 6).alias("bad_share"))


def op1_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(table(spark, sf_dir, "documents"))


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.personal_data(table(spark, sf_dir, "documents"))
    counts = [privacy.count_of("base", k).alias(f"n_{kind}") for k, kind in enumerate(privacy.KINDS)]
    return found.select("doc_id", *counts, F.sha2(privacy.written("base"), 256).alias("base_sha256"), privacy.written("all_spans").alias("spans"))


def op4_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "toxic", *(F.round(f"p_{c}", 6).alias(f"p_{c}") for c in toxicity.CATEGORIES))


def op5_column_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op9_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op11_marker_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def runs_digest(found: DataFrame) -> DataFrame:
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_lpf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_digest(periodic.periodic_runs(table(spark, sf_dir, "documents"), planted=True))


def op13_sharded_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives.write(table(spark, sf_dir, "pages"), folder)
    return archives.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentence_rules": op1_sentence_rules,
    "op2_contextual_pii": op2_contextual_pii,
    "op3_line_rules": op3_line_rules,
    "op4_anisotropic": op4_anisotropic,
    "op5_column_generation": op5_column_generation,
    "op6_classifier_chain": op6_classifier_chain,
    "op7_kd_tree": op7_kd_tree,
    "op8_path_templates": op8_path_templates,
    "op9_chunked_bpe": op9_chunked_bpe,
    "op10_chosen_path": op10_chosen_path,
    "op11_marker_injection": op11_marker_injection,
    "op12_lpf_runs": op12_lpf_runs,
    "op13_sharded_writer": op13_sharded_writer,
}
