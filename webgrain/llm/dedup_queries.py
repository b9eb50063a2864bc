"""The queries op8 and op9 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webgrain.llm import cdc_dedup, jaccard_join
from webgrain.llm._spark import read_table


def op9_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return cdc_dedup.dedup_substrings(docs).select(
        "doc_id", "n_chunks", "n_dup_chunks", "n_removed_bytes", "first_ids", "removed", "text"
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs, width=3, percent=90).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS k FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 90 * (na.n + nb.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY a
"""
