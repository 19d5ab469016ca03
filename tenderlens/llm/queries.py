"""Thin queries over the training-data operators: each applies one operator to its whole table and derives the digest
columns from the operator's own result. ORACLES holds DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op2_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_documents

    return near_documents(table(spark, sf_dir, "documents"), 75)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"))


def op5_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import kd_shards

    out = kd_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, toxicity

    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    net = fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    out = toxicity(docs, net)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_spherical_cap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .caps import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_jaccard_components, op3_license_scan, op4_katz_backoff, op5_kd_tree_sharding, op6_toxicity_gru, op7_best_fit_packing, op8_html_main_text, op9_spherical_cap_links,
    op10_line_dedup,
)}


def _oracles() -> dict[str, str]:
    from . import license_scan

    return {"op3_license_scan": license_scan.oracle()}


ORACLES: dict[str, str] = _oracles()
