"""Tables of fixed columns in CSV files, and which file of a folder to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.functions import url
from webgrain.functions.base import filled, first_filled, trim
from webgrain.sources.files import read_csv
from webgrain.sources.sinks import write_csv

# The columns of each format, in their order, and the names of its files.
CANDIDATES = [
    "ds_id", "ds_number", "project_id", "project_title", "project_status", "project_type", "turnaround_type", "shop_code",
    "source_column", "raw_url", "normalized_url", "domain", "canonical_domain", "first_req_description", "first_req_note",
]
REVIEWS = [
    "ds_number", "ds_id", "project_title", "project_type", "shop_code", "normalized_url", "domain", "canonical_domain",
    "source_column", "first_req_description_excerpt", "first_req_note_excerpt", "status", "elapsed_ms", "error_message",
    "extracted_business_name", "extracted_business_category", "extracted_tagline", "extracted_summary", "extracted_emails",
    "extracted_phone_numbers", "extracted_social_links", "extracted_addresses", "extracted_contact_links", "extracted_products",
    "extracted_services", "extracted_products_services", "logo_candidate_count", "selected_logo_url", "logo_candidate_urls",
    "extracted_color_hexes", "primary_color_hex", "secondary_color_hex", "palette_source", "palette_confidence",
    "palette_raw_color_count", "palette_distinct_color_count", "pages_inspected", "extraction_provider", "extraction_model",
    "business_name_score", "category_score", "logo_score", "brief_score", "overall_score", "reviewer_notes",
    "business_name_similarity_hint", "title_business_name_overlap_hint", "extraction_run_id", "processed_at",
    "source_review_queue", "duplicate_source_urls",
]
COMBINED = [*REVIEWS, "latest_rerun_status", "latest_rerun_timestamp", "preserved_previous_success", "preserved_richer_contact"]
SUMMARIES = [
    "ds_number", "project_title", "project_type", "shop_code", "normalized_url", "domain", "canonical_domain", "status",
    "elapsed_ms", "error_message", "extracted_business_name", "logo_candidate_count", "pages_inspected",
]
RUN_ID = r"20\d{12}(?:\d{3})?"
KINDS = {
    "url_candidates": r"^url_candidates_.*\.csv$",
    "extraction_summary": r"^(manual_)?extraction_summary_.*\.csv$",
    "review_queue": r"^(manual_)?review_queue_.*\.csv$",
    "score_summary": r"^score_summary_.*\.csv$",
    "extraction_run": r"^(manual_)?extraction_run_.*\.jsonl$",
}
COMBINED_NAME = r"^review_queue_combined_\d+\.csv$"
SMALL_NAME, SMALL_ROWS = "(?i)example|smoke|test", 50
METRICS = [
    "total_rows", "rows_with_overall_score", "rows_missing_overall_score", "reviewer_notes_non_empty_count",
    "extraction_success_count", "extraction_failed_count",
]


def _with_canonical(df: DataFrame) -> DataFrame:
    """canonical_domain from domain where it is blank."""
    return df.withColumn("canonical_domain", F.coalesce(filled(F.col("canonical_domain")), url.canonical_domain_or_null(F.col("domain")), F.lit("")))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return _with_canonical(read_csv(spark, path, CANDIDATES))


def candidate_rows(records: DataFrame) -> DataFrame:
    """Candidates of records with a normalized_url: it is normalised anew, and rows without a URL go."""
    known = {c.strip().lower(): c for c in records.columns}
    cells = records.select(*((trim(F.col(f"`{known[c]}`")) if c in known else F.lit("")).alias(c) for c in CANDIDATES))
    found = cells.withColumn("normalized_url", F.coalesce(url.normalize(F.col("normalized_url")), url.normalize_weak(F.col("normalized_url"))))
    found = found.filter(F.col("normalized_url").isNotNull())
    return _with_canonical(found.withColumn("domain", F.coalesce(first_filled(F.col("domain"), url.host_of(F.col("normalized_url"))), F.lit(""))))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, REVIEWS)


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, COMBINED)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return _with_canonical(read_csv(spark, path, SUMMARIES))


def write_typed(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns as texts; null and lacking ones are blank cells."""
    have = set(df.columns)
    cells = (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("") for c in columns)
    write_csv(df.select(*(cell.alias(c) for cell, c in zip(cells, columns, strict=True))), path, columns)


def read_score_summary(rows: DataFrame) -> DataFrame:
    """One row from (section, key, value) rows: input_file, the metrics (0 where they are no numbers), averages, status counts and notes.

    Of rows with one section and key the last counts.
    """
    each = rows.select(*(trim(F.col(c)).alias(c) for c in ("section", "key", "value")), F.monotonically_increasing_id().alias("at")).filter("section <> '' AND key <> ''")
    cells = each.groupBy("section", "key").agg(F.max_by("value", "at").alias("value"))
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0)).cast("long")

    def of(section: str, value: Column) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("section") == section, F.struct("key", value.alias("value"))))))

    def meta(key: str) -> Column:
        return F.max(F.when((F.col("section") == "meta") & (F.col("key") == key), F.col("value")))

    is_note = (F.col("section") == "reviewer_notes") & F.col("key").startswith("top_")
    place = F.substring("key", 5, 9).try_cast("int")
    notes = F.array_sort(F.collect_list(F.when(is_note, F.struct(place.alias("place"), F.col("value").alias("note")))))
    return cells.agg(
        F.coalesce(meta("input_file"), F.lit("")).alias("input_file"),
        *(number(meta(m)).alias(m) for m in METRICS),
        of("average", F.col("value")).alias("averages"),
        of("status", number(F.col("value"))).alias("status_counts"),
        F.transform(notes, lambda n: n["note"]).alias("top_notes"),
    )


def kind_of(name: Column) -> Column:
    """The kind of a file by its name, or null."""
    return F.coalesce(*(F.when(name.rlike(pattern), kind) for kind, pattern in KINDS.items()))


def run_id_in(name: Column) -> Column:
    """The run id that a file's name ends with, or null."""
    return filled(F.regexp_extract(name, rf"_({RUN_ID})\.(csv|jsonl)$", 1))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, kind, modified, bytes, run_id) of a folder's files of known kinds; their contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "length")
    named = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return named.select("name", kind_of(F.col("name")).alias("kind"), "modified", "bytes", run_id_in(F.col("name")).alias("run_id")).filter("kind IS NOT NULL")


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """(name, n_rows) of CSV files, in one job over all of them."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    return rows.select(F.col("_metadata.file_name").alias("name")).groupBy("name").agg(F.count("*").alias("n_rows"))


def _first(files: DataFrame, *order: Column) -> DataFrame:
    """The one name that stands first."""
    return files.orderBy(*order, F.desc("modified"), "name").limit(1).select("name")


def _asked(requested: str | None) -> Column:
    return F.when(F.col("name") == F.lit(requested), 0).otherwise(1)


def pick_candidates(files: DataFrame, counts: DataFrame, requested: str | None = None) -> DataFrame:
    """The requested file, else the largest by rows, then bytes, then time; small and example ones only if there are no others."""
    own = files.filter(F.col("kind") == "url_candidates").join(counts, "name", "left")
    small = F.col("name").rlike(SMALL_NAME) | F.coalesce(F.col("n_rows") < SMALL_ROWS, F.lit(False))
    return _first(own, _asked(requested), small, F.desc(F.coalesce("n_rows", F.lit(0))), F.desc("bytes"))


def pick_reviews(files: DataFrame, requested: str | None = None) -> DataFrame:
    """The requested file; 'combined' or 'latest' the newest combined or batch file; else the newest combined, else the newest batch file."""
    own = files.filter(F.col("kind") == "review_queue")
    combined = F.col("name").rlike(COMBINED_NAME)
    if requested in ("combined", "_combined"):
        return _first(own.filter(combined))
    if requested in ("latest", "_latest"):
        return _first(own.filter(~combined))
    return _first(own, _asked(requested), F.desc(combined))


def pick_newest(files: DataFrame, kind: str, requested: str | None = None) -> DataFrame:
    return _first(files.filter(F.col("kind") == kind), _asked(requested))


def pick_match(files: DataFrame, kind: str, *names: str | None) -> DataFrame:
    """The file of a kind with the run id of the first of the names that has a match, else the newest."""
    ids = [run_id_in(F.lit(n)) for n in names if n]
    exact = F.regexp_extract("name", rf"^(?:manual_)?{kind}_({RUN_ID})\.(?:csv|jsonl)$", 1)
    order = F.coalesce(*(F.when(exact == run, n) for n, run in enumerate(ids)), F.lit(len(ids)))
    return _first(files.filter(F.col("kind") == kind), order)
