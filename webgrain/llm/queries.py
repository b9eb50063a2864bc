"""The queries op1 to op13: each operator on its whole table, as digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm import bpe_prefix, chat_format, hash_tree
from webgrain.llm._spark import read_table
from webgrain.llm.classifier_queries import op2_language_id, op3_quality_lr
from webgrain.llm.decontamination_query import OP6_SQL, op6_positional_index
from webgrain.llm.dedup_queries import OP8_SQL, op8_jaccard_join, op9_cdc_dedup
from webgrain.llm.lm_query import op5_lm_bloom
from webgrain.llm.merkle_query import OP12_SQL, op12_merkle_manifest
from webgrain.llm.pii_query import OP13_SQL, op13_pii_spans
from webgrain.llm.spelling_query import OP11_SQL, op11_spelling_groups
from webgrain.llm.url_filter_query import OP7_SQL, op7_url_filter

#: Texts full of control strings, added to the conversations.
PROBE_CONV, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"

RANKS = "byte_bpe_50k.tiktoken"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe; rows without a conversation id belong to none and are left out."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_CONV).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    examples = chat_format.expand(turns.unionByName(probe))
    read = F.transform(chat_format.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    rows = examples.select(
        "conv_id",
        "example",
        "n_turns",
        F.length("formatted").cast("long").alias("chars"),
        F.array_join(read, "").alias("turns"),
        chat_format.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("reply"),
    )
    gathered = rows.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max_by("turns", "n_turns").alias("turns"),
        F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_rows"),
    )
    loss = F.array_join(F.transform("replies", lambda r: F.coalesce(r["reply"], F.lit(""))), "")
    return gathered.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_rows",
    )


OP1_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT {PROBE_CONV}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_CONV}, 1, 'assistant', '{PROBE_TEXT}'
), o AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '[\\#<:]')) + length(text) + len(regexp_extract_all(text, '[\\#<]')) + 15 AS chars,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix, role = 'assistant' OR k = n AS is_row FROM o
)
SELECT conv_id, max(n) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix) FILTER (is_row) AS BIGINT) AS formatted_chars,
  count(*) FILTER (is_row) AS n_rows
FROM p GROUP BY conv_id
"""


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hash_tree.shard_documents(read_table(spark, sf_dir, "documents"), shards=24)
    return docs.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_prefix.encode(docs, ranks, public_tokenizers.PATTERN, decoded_col="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_language_id": op2_language_id,
        "op3_quality_lr": op3_quality_lr,
        "op4_hash_tree": op4_hash_tree,
        "op5_lm_bloom": op5_lm_bloom,
        "op6_positional_index": op6_positional_index,
        "op7_url_filter": op7_url_filter,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_cdc_dedup": op9_cdc_dedup,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_spelling_groups": op11_spelling_groups,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_pii_spans": op13_pii_spans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": OP1_SQL,
        "op6_positional_index": OP6_SQL,
        "op7_url_filter": OP7_SQL,
        "op8_jaccard_join": OP8_SQL,
        "op11_spelling_groups": OP11_SQL,
        "op12_merkle_manifest": OP12_SQL,
        "op13_pii_spans": OP13_SQL,
    }
