"""The query op5; the filter is a hash structure that SQL cannot express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webgrain.llm import lm_bloom
from webgrain.llm._spark import crc_fold, read_table


def op5_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = lm_bloom.train(docs.filter(crc_fold("doc_id", 10) != 0).select("text"))
    scored = lm_bloom.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (crc_fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
