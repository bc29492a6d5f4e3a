"""The registered queries of the operators, each over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard, language, lines, merkle, mixing, negatives, packing, quality, repeats, secrets, sharding, urls
from .oracle import ORACLE_SQL

URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = sharding.assign_shards(_table(spark, sf_dir, "documents"))
    return assigned.select(
        "doc_id",
        F.col("size").cast("long").alias("size"),
        F.col("text_crc32").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = _table(spark, sf_dir, "documents")
    # A null doc_id is not held out; only documents known to be so may not teach.
    found = language.identify(docs, ~F.coalesce(held_out, F.lit(False)))
    return found.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    # A cut may divide a character; its rest is shown as U+FFFD in kept_text only.
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_common_lines(_table(spark, sf_dir, "documents"))
    kept = F.sha2(F.encode("clean", "utf-8"), 256)
    return cleaned.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, base = F.col("spans"), F.filter("spans", lambda x: x["number"] < 3)

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secrets.find_secrets(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(F.encode(secrets.joined_spans(base), "utf-8"), 256).alias("base_sha256"),
        secrets.joined_spans(spans).alias("spans"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.rule_table(spark, URL_RULES)
    return urls.judge_urls(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings")
    return negatives.hard_negatives(rows, F.col("vec_id"), label, F.col("embedding"), F.col("id") % 100 == 0)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = packing.PackSettings(tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(_table(spark, sf_dir, "documents"), settings)
    checksum = F.crc32("ids").cast("long").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", checksum, "doc_tokens", "sequence_id", "offset")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    def leaf(n_chars: Column) -> Column:
        return merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    other = leaf(F.when(tampered, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars")))
    docs = _table(spark, sf_dir, "documents")
    manifest = merkle.build(docs, leaf(F.col("n_chars")), other=other)
    root = F.lit(manifest.root).cast("string")
    proofs = merkle.prove(manifest).select(
        F.col("request.doc_id").alias("doc_id"),
        F.col("request.leaf").alias("leaf"),
        "subroot",
        root.alias("root"),
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.col("request.other"), F.col("path")).alias("folded_root"),
    )
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_sharding,
        op2_language,
        op3_jaccard_join,
        op4_suffix_dedup,
        op5_decontamination,
        op6_line_dedup,
        op7_quality_rules,
        op8_secrets,
        op9_mixing,
        op10_url_filters,
        op11_negatives,
        op12_packing,
        op13_merkle,
    )
    return {x.__name__: x for x in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
