"""Status values, run ids, timestamps, scores and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgrain.functions.base import filled, one_of, trim

SUCCESS = ["success", "ok", "completed"]
FAILED = ["fetch_error", "extraction_error", "error", "failed", "timeout", "skipped"]
NOT_RUN = ["not_run", "pending", "missing", "no_data_yet", "no_data", "blank"]


def status(c: Column) -> Column:
    """success, failed or not_run; a blank is not_run, an unknown word is failed."""
    t = F.regexp_replace(F.lower(trim(c)), r"\s+", "_")
    return F.when((t == "") | t.isin(*NOT_RUN), "not_run").when(t.isin(*SUCCESS), "success").otherwise("failed")


def row_status(inventory: Column, summary: Column, review: Column) -> Column:
    """Of an inventory's status, an extraction summary's and a review's, the one that counts."""
    return (
        F.when(one_of(inventory, "not_run"), status(review))
        .when(trim(summary) != "", status(summary))
        .when(one_of(inventory, "success", "failed"), inventory)
        .otherwise(status(review))
    )


def outcome_rank(s: Column) -> Column:
    return F.when(s == "success", 3).when(s == "failed", 2).otherwise(1)


def run_id_iso(c: Column) -> Column:
    """A run id of 14 or 17 digits (date, time and milliseconds) as an ISO time in UTC, else null."""
    d = trim(c)
    iso = F.regexp_replace(F.substring(d, 1, 14), r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3T$4:$5:$6")
    ms = F.when(F.length(d) == 17, F.substring(d, 15, 3)).otherwise("000")
    valid = d.rlike(r"^(\d{14}|\d{17})$") & F.try_to_timestamp(iso).isNotNull()
    return F.when(valid, F.concat(iso, F.lit("."), ms, F.lit("Z")))


def run_id_of(name: Column) -> Column:
    """The digits of a batch, manual or combined review queue's file name, or ''."""
    return F.regexp_extract(trim(name), r"^(?:\w+_)?review_queue(?:_combined|_manual)?_(\d{14,17})\.csv$|^(?:historical|manual|combined)_review_queue_(\d+)\.csv$", 1)


def millis(c: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(c))


def sort_millis(processed_at: Column, run_id: Column, queue: Column) -> Column:
    """When a row was processed, in milliseconds: its own time, else its run's, else its file's, else 0."""
    own = millis(filled(processed_at))
    run = F.coalesce(filled(run_id), filled(run_id_of(queue)))
    return F.coalesce(own, millis(run_id_iso(run)), run.try_cast("long"), F.lit(0).cast("long"))


def score_kind(c: Column) -> Column:
    """blank, na, 0, 1, 2, 3 or invalid."""
    t = F.lower(trim(c))
    return F.when(t == "", "blank").when(t == "n/a", "na").when(t.isin("0", "1", "2", "3"), t).otherwise("invalid")


def score_value(c: Column) -> Column:
    return F.when(score_kind(c).isin("0", "1", "2", "3"), score_kind(c).try_cast("double"))


def pages_inspected(c: Column) -> Column:
    """A number of pages, 0 or more, from the digits that a cell begins with; else null."""
    return F.regexp_extract(trim(c.cast("string")), r"^(\d+)", 1).try_cast("int")


DEPTH_BUCKETS = ["0", "1", "2", "3", "4-5", "6+"]


def depth_bucket(pages: Column) -> Column:
    return (
        F.when(pages.isNull() | (pages <= 0), "0")
        .when(pages <= 3, pages.cast("string"))
        .when(pages <= 5, "4-5")
        .otherwise("6+")
    )


def short_number(c: Column) -> Column:
    """Three decimals at most, without closing zeros; '' for null."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", c), "0+$", ""), r"\.$", "")
    return F.when(c.isNotNull(), text).otherwise("")
