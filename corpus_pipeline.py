"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the docs of the next one. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm import bpe_prefix, cdc_dedup, jaccard_join, positional_index, quality_lr
from webgrain.llm._spark import cut, read_table, row_key, without_keys
from webgrain.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the quality model reject go."""
    ship(spark)
    model = quality_lr.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_lr.score(docs, model).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word n-grams, Jaccard 0.8) the document with the least id stays."""
    ship(spark)
    return jaccard_join.keep_representatives(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document (or place) holds are taken out of the text."""
    ship(spark)
    found = cdc_dedup.dedup_substrings(docs)
    length = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", length).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    ship(spark)
    keyed = docs.select(row_key().alias("row_key"), "text")
    found = positional_index.find_contamination(keyed, read_table(spark, sf_dir, "benchmark"), id_col="row_key")
    return without_keys(docs, found.filter("n_hit > 0").select("row_key").distinct())


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids; text is what the ids decode to."""
    ship(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe_prefix.encode(docs, ranks, public_tokenizers.PATTERN, decoded_col="decoded")
    return decoded.select(
        *(c for c in docs.columns if c not in ("text", "n_tokens", "ids", "decoded")),
        F.col("decoded").cast("string").alias("text"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: The first stage learns a model, so SQL cannot express the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
