"""Publishing: what may leave, and in which form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.functions import status
from webgrain.functions import text as X
from webgrain.functions import url as U
from webgrain.functions.base import first_filled, trim
from webgrain.operators import presence as P

#: Columns that only partners may see.
PARTNER_COLUMNS = ["ds_id", "project_id", "project_title", "project_type", "shop_code", "source_column", "first_req_description_excerpt", "first_req_note_excerpt", "raw_url"]
#: Columns that are published as they are, trimmed.
PUBLIC_COLUMNS = [
    "status", "ds_number", "elapsed_ms", "pages_inspected", "extracted_business_name", "extracted_summary", "extracted_emails",
    "extracted_phone_numbers", "extracted_social_links", "extracted_addresses", "extracted_color_hexes", "primary_color_hex",
    "secondary_color_hex", "palette_source", "palette_confidence", "overall_score", "reviewer_notes", "source_review_queue",
    "extraction_run_id",
]


def without_partner_columns(df: DataFrame) -> DataFrame:
    return df.drop(*PARTNER_COLUMNS)


def sanitize_reviews(reviews: DataFrame, include_domains: bool = True, include_logos: bool = True, seq_col: str = "seq") -> DataFrame:
    """Public columns of each row: hosts instead of URLs (or 'Site n'), redacted errors, three logos at most."""
    host = F.coalesce(U.domain_key(F.col("canonical_domain"), F.col("domain"), F.col("normalized_url"), F.lit(None).cast("string")), F.lit(""))
    label = F.concat(F.lit("Site "), (F.col(seq_col) + 1).cast("string"))
    show = lambda shown, hidden: shown if include_domains else hidden
    logos = F.slice(P.json_objects(F.col("logo_candidate_urls")), 1, 3)
    own_time = F.coalesce(first_filled(F.col("processed_at")), status.run_id_iso(F.col("extraction_run_id")), F.lit(""))
    return reviews.select(
        F.col(seq_col),
        show(host, label).alias("domain"),
        show(host, F.lit("")).alias("canonical_domain"),
        show(F.when(host != "", F.concat(F.lit("https://"), host)).otherwise(""), F.lit("")).alias("normalized_url"),
        *(trim(F.col(c)).alias(c) for c in PUBLIC_COLUMNS if c in reviews.columns),
        X.redact_error(F.col("error_message")).alias("error_message"),
        own_time.alias("processed_at"),
        (F.size(logos) if include_logos else F.lit(0)).alias("n_logos"),
    )


def publish_stats(published: DataFrame) -> DataFrame:
    return published.agg(
        F.count("*").alias("n_published"),
        F.count_if(F.col("n_logos") > 0).alias("n_with_logos"),
        F.count_if(trim(F.col("extracted_color_hexes")) != "").alias("n_with_palettes"),
    )


def collapse_published(published: DataFrame, seq_col: str = "seq") -> DataFrame:
    """One row of each published URL: by status, then the first; run names united, those of batches before combined ones."""
    row = F.struct(*published.columns)
    rank = status.outcome_rank(status.status(F.col("status")))
    queue = F.struct(F.col("source_review_queue").contains("combined").alias("combined"), F.col(seq_col).alias("at"), F.col("source_review_queue").alias("name"))
    best = published.filter(F.col("normalized_url") != "").groupBy("normalized_url").agg(
        F.max_by(row, F.struct(rank.alias("rank"), (-F.col(seq_col)).alias("seq"))).alias("row"),
        F.min(F.when(trim(F.col("source_review_queue")) != "", queue)).alias("queue"),
        F.count("*").alias("n_rows"),
    )
    columns = [c for c in published.columns if c not in ("source_review_queue", "normalized_url")]
    return best.select("normalized_url", *(F.col(f"row.{c}").alias(c) for c in columns), F.coalesce("queue.name", F.lit("")).alias("source_review_queue"), "n_rows")
