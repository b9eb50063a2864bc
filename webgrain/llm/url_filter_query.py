"""The query op7 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm import url_filter
from webgrain.llm._spark import read_table

#: Dated entries of the lists: list, pattern, action, date.
ENTRIES = [
    *(("gambling", f"casino-win.example.{tld}", "add", "2024-01-15") for tld in ("com", "net", "org")),
    *(("gambling", f"free-bets.example.{tld}", "add", "2024-02-01") for tld in ("com", "net", "org")),
    *(("gambling", f"free-bets.example.{tld}", "remove", "2024-06-01") for tld in ("com", "net", "org")),
    *(("gambling", f"free-bets.example.{tld}", "add", "2024-09-01") for tld in ("com", "net", "org")),
    *(("adult", f"adult-x.example.{tld}", "add", "2023-11-20") for tld in ("com", "net", "org")),
    *(("spam", f"spam-farm.example.{tld}", "add", "2024-03-10") for tld in ("com", "net", "org")),
    *(("spam", f"cheap-pills.example.{tld}", "add", "2023-05-01") for tld in ("com", "net", "org")),
    *(("spam", f"cheap-pills.example.{tld}", "remove", "2024-04-01") for tld in ("com", "net", "org")),
    ("optout", "tionble.example.com", "add", "2024-07-01"),
    ("optout", "tionsh.example.net/de", "add", "2024-05-01"),
    ("optout", "tionsh.example.net/fr/", "add", "2024-05-01"),
    ("optout", "tionsh.example.net/fr/", "remove", "2024-05-01"),
    ("optout", "tionsh.example.net", "add", "2024-08-01"),
    ("optout", "tionsh.example.net", "remove", "2024-08-08"),
    ("optout", "tiontion.example.com/es", "add", "2024-02-10"),
    ("optout", "m.ththth.example.net", "add", "2024-10-01"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the lists as of its fetch time.

    The table has no fetch times, so each page gets one from its id: a minute
    of the year 2024.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    minute = F.pmod(F.col("page_id") * 7919, F.lit(527040))
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + minute * 60))
    entries = spark.createDataFrame(ENTRIES, "list string, pattern string, action string, dated string")
    found = url_filter.filter_urls(captures, entries)
    return found.select("page_id", "host", F.array_join("matches", ",").alias("matches"), "n_matches", "blocked")


_VALUES = ", ".join(f"('{a}', '{b.rstrip('/')}', '{c}', TIMESTAMP '{d}')" for a, b, c, d in ENTRIES)

OP7_SQL = rf"""
WITH e(list, key, action, dated) AS (VALUES {_VALUES}),
d AS (SELECT list, key, dated, bool_and(action = 'add') AS adds FROM e GROUP BY ALL),
i AS (SELECT *, lead(dated) OVER (PARTITION BY list, key ORDER BY dated) AS until FROM d),
p AS (
  SELECT page_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * CAST(page_id * 7919 % 527040 AS BIGINT) AS fetched,
    rtrim(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
    regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), m AS (
  SELECT p.page_id, p.host, i.list || ':' || i.key AS hit
  FROM p LEFT JOIN i ON i.adds AND p.fetched >= i.dated AND (i.until IS NULL OR p.fetched < i.until)
    AND (CASE WHEN contains(i.key, '/') THEN starts_with(p.host || p.path || '/', i.key || '/')
         ELSE ends_with('.' || p.host, '.' || i.key) END)
)
SELECT page_id, any_value(host) AS host, coalesce(string_agg(DISTINCT hit, ',' ORDER BY hit), '') AS matches,
  count(DISTINCT hit) AS n_matches, count(hit) > 0 AS blocked
FROM m GROUP BY page_id
"""
