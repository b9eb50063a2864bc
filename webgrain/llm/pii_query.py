"""The query op13 and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm import pii
from webgrain.llm._spark import read_table


def op13_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs).select("doc_id", "pii")

    def joined(spans: Column) -> Column:
        each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(each, ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(counted(k.name) for k in pii.KINDS if k.base),
        F.sha2(joined(F.filter("pii", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )


#: A character that texts lose before matching, so that it can mark the matches.
_MARK = "chr(57344)"


def _matched(kind: str, rank: int, pattern: str, holds: str) -> str:
    """Leftmost matches of a pattern with their places, which a mark put around each of them shows."""
    return f"""
  SELECT doc, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop, m FROM (
    SELECT doc, unnest(list_transform(range(2, len(p) + 1, 2), lambda k: {{'m': p[k], 'start': length(array_to_string(p[:k - 1], ''))}}), recursive := true)
    FROM (SELECT doc, string_split(regexp_replace(text, '({pattern})', {_MARK} || '\\1' || {_MARK}, 'g'), {_MARK}) AS p FROM d)
  ) WHERE {holds}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: list_extract([0,1,2,3,4,5,6,7,8,9,0,2,4,6,8,1,3,5,7,9], CAST(1 + 10 * ((k + 1) % 2) + CAST(reverse({_DIGITS})[k] AS INT) AS BIGINT)))) % 10 = 0"
_IBAN = "replace(m, ' ', '')"
_IBAN_DIGITS = f"string_split({_IBAN}[5:] || {_IBAN}[:4], '')"
_MOD_97 = f"""length({_IBAN}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform({_IBAN_DIGITS},
      lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 ELSE CAST(c AS INT) END)), lambda a, b: (a * (CASE WHEN b > 9 THEN 100 ELSE 10 END) + b) % 97) = 1"""
_HOLDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: regexp_full_match(x, '0*([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])')))"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _MOD_97),
    "national_id": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "m[1:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:] <> '0000'"),
    "local_phone": (r"\b[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b", "m[1] > '1'"),
}
_KINDS = ", ".join(f"({r}, {k.score}, '(?i)\\b(?:{k.context})\\b', {str(k.base).lower()})" for r, k in enumerate(pii.KINDS))

OP13_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, translate(coalesce(text, ''), {_MARK}, chr(57345)) AS text FROM documents
), kinds(rank, score, context, base) AS (VALUES {_KINDS}
), m AS MATERIALIZED ({" UNION ALL ".join(_matched(k.name, r, *_HOLDS[k.name]) for r, k in enumerate(pii.KINDS))}
), near AS (
  SELECT m.*, kinds.* EXCLUDE (rank), substr(text, greatest(0, start - {pii.CONTEXT_BEFORE}) + 1, least(start, {pii.CONTEXT_BEFORE})) || chr(10) || substr(text, stop + 1, {pii.CONTEXT_AFTER}) AS beside
  FROM m JOIN kinds USING (rank) JOIN d USING (doc)
), scored AS MATERIALIZED (
  SELECT * REPLACE (round(score + {pii.CONTEXT_GAIN} * (CAST(regexp_matches(beside, context) AS INT) - CAST(regexp_matches(beside, '(?i)\b(?:{pii.AGAINST})\b') AS INT)), 2) AS score) FROM near
), reported AS (
  SELECT * FROM scored s WHERE base OR (score >= {pii.THRESHOLD} AND NOT EXISTS (
    SELECT 1 FROM scored e WHERE e.doc = s.doc AND e.rank < s.rank AND (e.base OR e.score >= {pii.THRESHOLD}) AND e.start < s.stop AND e.stop > s.start))
), o AS (
  SELECT doc, {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS if k.base)},
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) FILTER (base) AS base_spans,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) AS spans
  FROM reported GROUP BY doc
)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in pii.KINDS if k.base)},
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (doc)
"""
