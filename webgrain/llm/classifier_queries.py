"""The queries op2 and op3; both learn, so SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm import language_id, quality_lr
from webgrain.llm._spark import crc_fold, read_table


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(crc_fold("doc_id", 5) != 0).select("lang", "text"))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op3_quality_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = quality_lr.score(docs.select("doc_id", "text"), quality_lr.train(docs, labels))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )
