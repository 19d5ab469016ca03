"""From raw documents to packed training sequences, in five stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm.common import Scratch, table

#: Documents that score this much or more are rejected as toxic: the cut at which the score is calibrated.
TOXIC = 0.3
#: So many ids of documents that go are sent to the executors at most; more are joined by a shuffle of the texts.
GONE = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but those of ``ids(doc_id)``; where these are few the texts are not shuffled. Null ids stay."""
    ids = Scratch(docs.sparkSession).save(ids.distinct())
    few = F.broadcast(ids) if ids.count() <= GONE else ids
    return docs.join(few, "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go. It learns from the labelled documents among the stage's input that
    op6 may learn from. Texts that are null or empty score low and stay."""
    from tenderlens.llm.toxicity import fit, keep_clean

    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    net = fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return keep_clean(docs, net, TOXIC)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in the first document that has them or, from nine characters on, one within two edits; a document of which nothing remains goes."""
    from tenderlens.llm.line_dedup import dedup_lines

    out = dedup_lines(docs).where("n_removed = 0 or trim(text) <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by Jaccard similarity 0.75 of five-word shingles, the one of least id stays."""
    from tenderlens.llm.jaccard import near_documents

    return without(docs, near_documents(docs, 75).where("doc_id <> component_id").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words stand in benchmark windows go; others stay as they are."""
    from tenderlens.llm.decontam import contamination

    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0 and 20 * n_hit >= n_words")
    return without(docs, found.select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences of 2048 tokens."""
    import public_tokenizers

    from tenderlens.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontamination), ("best_fit_packing", packing)]
#: The network and the edit join are not expressible in SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
