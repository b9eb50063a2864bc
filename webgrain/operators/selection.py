"""Batch selection: which candidates to process next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions import url as U
from webgrain.functions.base import any_of
from webgrain.operators.dedup import dedupe_candidates, first_by_key
from webgrain.operators.presence import has_colors, has_email, has_logo, has_phone, has_address, has_social

CONTACT_FIELDS = {"email": has_email, "phone": has_phone, "address": has_address, "social": has_social}


@dataclass(frozen=True)
class Options:
    """How to select; contact names the fields of which one must be missing."""

    limit: int = 25
    offset: int = 0
    retry_failed: bool = False
    reprocess: bool = False
    missing_colors: bool = False
    missing_contact: tuple[str, ...] = ()
    root_first: bool = True
    root_only: bool = False
    allow_duplicate_domains: bool = False


def candidate_key() -> Column:
    return U.site_key(F.col("canonical_domain"), F.col("domain"), F.col("normalized_url"), F.col("raw_url"))


def processed_index(reviews: DataFrame, seq_col: str = "seq") -> DataFrame:
    """(site_key, processed, review): of each site the last row; success only if its status says just that."""
    key = U.site_key(F.col("canonical_domain"), F.col("domain"), F.col("normalized_url"), F.lit(None).cast("string"))
    done = F.when(F.trim("status") == "success", "success").otherwise("failed")
    rows = reviews.select(key.alias("site_key"), F.struct(done.alias("processed"), F.struct(*reviews.columns).alias("review")).alias("row"), F.col(seq_col).alias("_seq"))
    return rows.filter("site_key IS NOT NULL").groupBy("site_key").agg(F.max_by("row", "_seq").alias("row")).select("site_key", "row.*")


def is_eligible(o: Options, status: Column) -> Column:
    retry = (status == "failed") & F.lit(o.retry_failed)
    if o.missing_contact:
        lacks = any_of(*(~CONTACT_FIELDS[f]("review.") for f in o.missing_contact))
        return retry | ((status == "success") & F.col("review").isNotNull() & lacks)
    if o.missing_colors:
        lacks = has_logo("review.") & ~has_colors("review.")
        return (status == "not_run") | retry | ((status == "success") & F.col("review").isNotNull() & lacks)
    return F.lit(True) if o.reprocess else (status == "not_run") | retry


def eligible_candidates(candidates: DataFrame, reviews: DataFrame | None, o: Options) -> DataFrame:
    """Deduplicated candidates that the mode admits, with status and priority. Without reviews all are admitted.

    The default mode needs no review columns, so it is an anti-join on site keys.
    """
    rows = dedupe_candidates(candidates)
    if not o.allow_duplicate_domains:
        rows = first_by_key(rows, F.col("canonical_domain"), F.col("seq"), keep_blank=True)
    rows = rows.withColumn("site_key", candidate_key())
    if reviews is None:
        rows = rows.withColumn("status", F.lit("not_run"))
    elif not (o.retry_failed or o.reprocess or o.missing_colors or o.missing_contact):
        rows = rows.join(processed_index(reviews).select("site_key"), "site_key", "left_anti").withColumn("status", F.lit("not_run"))
    else:
        rows = rows.join(processed_index(reviews), "site_key", "left").withColumn("status", F.coalesce("processed", F.lit("not_run")))
        rows = rows.filter(is_eligible(o, F.col("status"))).drop("processed", "review")
    url = F.coalesce(F.nullif(F.trim("normalized_url"), F.lit("")), "raw_url")
    rows = rows.withColumns({"path_type": U.path_type(url), "priority": U.priority(url)})
    return rows.filter("path_type = 'root'") if o.root_only else rows


def select_batch(candidates: DataFrame, reviews: DataFrame | None, o: Options) -> DataFrame:
    """The batch: by priority (or in the given order), from offset, limit rows at most; rank counts from 1.

    A top-k: only offset + limit rows reach the last step.
    """
    rows = eligible_candidates(candidates, reviews, o)
    order = ["priority", "seq"] if o.root_first else ["seq"]
    top = rows.orderBy(*order, "url_key").limit(o.offset + max(o.limit, 0))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order, "url_key")).cast("long"))
    return ranked.filter((F.col("rank") > o.offset) & F.lit(o.limit > 0))


def count_by_path_type(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.count_if(F.col("path_type") == t).alias(t) for t in ("root", "shallow", "deep")))
