"""URL mining: from an export's rows to a table of URL candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.functions import text as X
from webgrain.functions import url as U
from webgrain.functions.base import filled, first_filled, trim

TEXT_COLUMNS = ["first_req_description", "first_req_note", "project_title"]
URL_COLUMNS = ["website_url", "website", "url", "site_url", "homepage"]
KEY_ALIASES = ["ds_number", "dsnumber", "ds number", "ds", "source_ds_number", "original_ds_number"]
CARRIED = ["ds_id", "ds_number", "project_id", "project_title", "project_status", "project_type", "turnaround_type", "shop_code", "first_req_description", "first_req_note"]


def with_known_columns(export: DataFrame) -> DataFrame:
    """The export's columns by their lower-case names, blanks for those it lacks, and ds_number from its aliases."""
    have = {c.strip().lower(): c for c in export.columns}
    cell = lambda c: trim(F.col(f"`{have[c]}`")) if c in have else F.lit("")
    key = F.coalesce(*(filled(cell(c)) for c in KEY_ALIASES if c in have), F.lit(""))
    names = dict.fromkeys([*CARRIED, *TEXT_COLUMNS, *URL_COLUMNS])
    seq = F.col("seq") if "seq" in export.columns else F.monotonically_increasing_id()
    return export.select(seq.alias("seq"), *(key.alias(c) if c == "ds_number" else cell(c).alias(c) for c in names))


def mine_candidates(export: DataFrame) -> DataFrame:
    """A row for each URL of each export row: from texts (URLs, then bare domains) and from URL columns.

    In a row, a URL counts once; source_column names all columns that hold it.
    Candidates keep the row's order in seq and the order of finds in at.
    """
    rows = with_known_columns(export)
    found_in = lambda c: lambda u: F.struct(F.lit(c).alias("source"), u.alias("raw_url"))
    finds = [F.transform(X.urls_in_text(F.col(c)), found_in(c)) for c in TEXT_COLUMNS]
    direct = [F.filter(F.array(found_in(c)(F.col(c))), lambda s: s["raw_url"] != "") for c in URL_COLUMNS]
    each = rows.select(*(c for c in rows.columns if c not in URL_COLUMNS), F.posexplode(F.concat(*finds, *direct)).alias("at", "find"))
    each = each.select("*", F.col("find.raw_url").alias("raw_url"), F.col("find.source").alias("source_column"), U.normalize_weak(F.col("find.raw_url")).alias("normalized_url"))
    each = each.filter("normalized_url IS NOT NULL").drop("find")
    row = F.struct(*(c for c in each.columns if c not in ("source_column", "at")))
    identity = F.concat_ws("|", first_filled(F.col("ds_id"), F.col("ds_number")), F.col("seq").cast("string"))
    merged = each.groupBy(identity.alias("identity"), "normalized_url").agg(
        F.min_by(row, "at").alias("row"), F.min("at").alias("at"), F.array_sort(F.collect_set(F.struct("at", "source_column"))).alias("sources")
    )
    sources = F.array_join(F.array_distinct(F.transform("sources", lambda s: s["source_column"])), "; ")
    found = merged.select("row.*", "at", sources.alias("source_column"))
    host = U.domain(F.col("normalized_url"))
    return found.withColumns({"domain": host, "canonical_domain": U.canonical_domain(host)})


def mining_summary(export: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: rows read, with and without candidates, candidates and distinct domains."""
    total = export.agg(F.count("*").alias("rows_read"))
    found = candidates.agg(F.count_distinct("seq").alias("rows_with"), F.count("*").alias("candidates"), F.count_distinct("domain").alias("domains"))
    return total.join(found).select("rows_read", "rows_with", (F.col("rows_read") - F.col("rows_with")).alias("rows_without"), "candidates", "domains")


def by_source(candidates: DataFrame) -> DataFrame:
    """How many candidates each source column has."""
    source = F.explode(F.split("source_column", "; ")).alias("source_column")
    return candidates.select(source).groupBy("source_column").agg(F.count("*").alias("n"))


def normalize_export(export: DataFrame) -> DataFrame:
    """The export with website_url, website_url_source and skip_reason."""
    rows = with_known_columns(export)
    found = U.resolve_export_url([*URL_COLUMNS, "shop_code"])
    reason = F.when(F.col("website_url").isNull(), F.lit("no_website_url")).otherwise("")
    return (
        rows.withColumn("found", found)
        .drop(*URL_COLUMNS)
        .withColumns({"website_url": F.col("found.url"), "website_url_source": F.col("found.source")})
        .withColumn("skip_reason", reason)
        .drop("found")
    )
