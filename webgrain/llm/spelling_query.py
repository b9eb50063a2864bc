"""The query op11 and its SQL."""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm import spelling
from webgrain.llm._spark import read_table

#: A run loses a code point if this number divides the checksum of its document and itself.
DIVISOR = 97
MIN_LENGTH, MIN_COUNT = 5, 3


def planted(doc: str, words: Counter) -> Counter:
    """The words of a document with a code point taken out of about one in 97."""
    seed, out = zlib.crc32(f"{doc}:".encode()), words.copy()
    for word, n in words.items():
        h = zlib.crc32(word.encode(), seed)
        if h % DIVISOR == 0:
            k = h % len(word)
            out[word] -= n
            out[word[:k] + word[k + 1 :]] += n
    return +out


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(read_table(spark, sf_dir, "documents"), change=planted)
    frequent = words.filter((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT))
    return spelling.spelling_groups(frequent).select("word", "form", "root", "n", "n_near", "form_n")


def crc32_sql(byte_list: str, table: str = "crc_table") -> str:
    """crc32 of a list of bytes; table is a list of 256 numbers."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte_list}), lambda c, b: xor(c >> 8, {table}[1 + (xor(c, b) & 255)])), CAST(4294967295 AS BIGINT))"


#: The table of crc32 from its rule: eight steps of shifting and adding the polynomial.
CRC_TABLE_SQL = "(SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY i) AS crc_table FROM range(256) t(i))"

_BYTES = "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))"

OP11_SQL = rf"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
  ) GROUP BY ALL
), h AS (SELECT run, n, {crc32_sql(_BYTES)} AS h FROM runs, {CRC_TABLE_SQL}
), w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {DIVISOR} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h
  ) WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
), k AS MATERIALIZED (
  SELECT DISTINCT word, n, unnest(list_prepend(word, list_transform(range(length(word)), lambda p: word[:p] || word[p + 2:]))) AS key FROM w
), near AS MATERIALIZED (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM k a JOIN k b USING (key)
  WHERE a.word <> b.word AND (key IN (a.word, b.word) OR list_sum(list_transform(range(1, length(a.word) + 1), lambda p: CAST(a.word[p] <> b.word[p] AS INT))) = 1)
), best AS MATERIALIZED (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY ALL
), way AS (
  SELECT word, other AS final FROM best WHERE other_n >= 2 * n
  UNION ALL SELECT way.word, best.other FROM way JOIN best ON best.word = way.final WHERE best.other_n >= 2 * best.n
), last AS (SELECT word, final FROM way WHERE final NOT IN (SELECT word FROM best WHERE other_n >= 2 * n))
SELECT w.word, CASE WHEN other_n >= 2 * w.n THEN other END AS form, coalesce(last.final, w.word) AS root, w.n,
  coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
FROM w LEFT JOIN best USING (word) LEFT JOIN last USING (word)
"""
