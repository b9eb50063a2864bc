"""Deduplication by a key: the first row of each key wins.

All are aggregations with a partial step, so a key that many rows share sends
one row for each task to the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.functions import url as U
from webgrain.functions.base import trim


def first_by_key(df: DataFrame, key: Column, seq: Column, keep_blank: bool = False) -> DataFrame:
    """The row with the least seq of each key, with all columns.

    Rows without a key (null or '') go, or with keep_blank all stay.
    """
    row = F.struct(*df.columns)
    keyed = df.select(row.alias("row"), key.cast("string").alias("key"), seq.alias("seq"))
    has = F.coalesce(F.col("key") != "", F.lit(False))
    first = keyed.filter(has).groupBy("key").agg(F.min_by("row", "seq").alias("row")).select("row.*")
    return first.unionByName(keyed.filter(~has).select("row.*")) if keep_blank else first


def dedupe_candidates(df: DataFrame, seq_col: str = "seq") -> DataFrame:
    """URL candidates, one of each normalised URL.

    The first row wins; the source columns of the others join its own ('; ', in
    the order of rows). Rows whose URL cannot be normalised go. Adds url_key and
    n_rows.
    """
    key = U.dedupe_key(F.col("normalized_url"), F.col("raw_url"), F.col("domain"))
    columns = [c for c in df.columns if c != "source_column"]
    rows = df.withColumn("url_key", key).filter("url_key IS NOT NULL")
    named = rows.select("url_key", F.col(seq_col).alias("at"), F.explode(F.split(F.coalesce("source_column", F.lit("")), ";")).alias("s"))
    sources = (
        named.groupBy("url_key", trim(F.col("s")).alias("s"))
        .agg(F.min("at").alias("at"))
        .groupBy("url_key")
        .agg(F.array_sort(F.collect_list(F.when(F.col("s") != "", F.struct("at", "s")))).alias("found"))
        .select("url_key", F.array_join(F.array_distinct(F.transform("found", lambda x: x["s"])), "; ").alias("source_column"))
    )
    first = rows.groupBy("url_key").agg(F.min_by(F.struct(*columns), seq_col).alias("row"), F.count("*").alias("n_rows"))
    return first.join(sources, "url_key").select("row.*", "source_column", "url_key", "n_rows")


def dedupe_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: n_before, n_after, n_removed; rows that were dropped count as removed."""
    a = before.agg(F.count("*").alias("n_before"))
    b = after.agg(F.count("*").alias("n_after"))
    return a.join(b).select("n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"))


def drop_near_duplicate_pages(pages: DataFrame, site_col: str = "site", seq_col: str = "seq", text_col: str = "text") -> DataFrame:
    """Pages of a site without those that mostly repeat an earlier page of it.

    A page is compared with the earlier pages of its own site; each site holds a
    handful of pages (a scrape takes four at most).
    """
    from webgrain.functions.text import is_mostly_duplicate

    a, b = pages.alias("a"), pages.select(site_col, seq_col, text_col).alias("b")
    same = (F.col(f"a.{site_col}") == F.col(f"b.{site_col}")) & (F.col(f"b.{seq_col}") < F.col(f"a.{seq_col}"))
    return a.join(b, same & is_mostly_duplicate(F.col(f"a.{text_col}"), F.col(f"b.{text_col}")), "left_anti")
