"""Reviewers' scores: distributions, averages, notes; field scores of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions import status
from webgrain.functions import text as X
from webgrain.functions.base import trim

SCORE_COLUMNS = ["business_name_score", "category_score", "logo_score", "brief_score", "overall_score"]
KINDS = ["0", "1", "2", "3", "na", "blank", "invalid"]


def score_distribution(reviews: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(score, kind, n) for each score column and kind, zeros included, from one pass."""
    columns = columns or SCORE_COLUMNS
    counts = reviews.agg(*(F.count_if(status.score_kind(F.col(c)) == k).alias(f"{c}|{k}") for c in columns for k in KINDS))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("score"), F.lit(k).alias("kind"), F.col(f"`{c}|{k}`").alias("n")) for c in columns for k in KINDS)))
    return counts.select(rows.alias("r")).select("r.*")


def score_averages(reviews: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(score, average): means over values from 0 to 3 only, null without any."""
    columns = columns or SCORE_COLUMNS
    means = reviews.agg(*(F.avg(status.score_value(F.col(c))).alias(c) for c in columns))
    return means.select(F.explode(F.array(*(F.struct(F.lit(c).alias("score"), F.col(c).alias("average")) for c in columns))).alias("r")).select("r.*")


def top_notes(reviews: DataFrame, column: str = "reviewer_notes", most: int = 5) -> DataFrame:
    """The most frequent notes: by count, then text, with rank."""
    note = trim(F.col(column))
    counts = reviews.select(note.alias("note")).filter("note <> ''").groupBy("note").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "note").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "note")).cast("long"))


def score_rows(distribution: DataFrame, averages: DataFrame) -> DataFrame:
    """The summary as (section, key, value) rows."""
    a = distribution.select(F.lit("distribution").alias("section"), F.concat_ws(".", "score", "kind").alias("key"), F.col("n").cast("string").alias("value"))
    return a.unionByName(averages.select(F.lit("average").alias("section"), F.col("score").alias("key"), status.short_number(F.col("average")).alias("value")))


def exact_score(expected: Column, found: Column) -> Column:
    """N/A without an expectation, 0 without a find, 3 if one holds the other, else 'review'."""
    e, f = X.comparable(expected), X.comparable(found)
    return F.when(e == "", "N/A").when(f == "", "0").when(f.contains(e) | e.contains(f), "3").otherwise("review")


def present_score(found: Column) -> Column:
    return F.when(trim(found) == "", "0").otherwise("review")


# The columns of field scores, and the notes that go with each outcome.
FIELD_SCORES = ["run_id", "ds_id", "ds_number", "website_url", "mode", "run_status", "field", "historical_value", "extracted_value", "score", "score_method", "notes"]
BOTH_EMPTY, NO_HISTORY, NOTHING_FOUND = "both empty", "no historical value", "extracted empty"
MATCHED, UNMATCHED = "normalized match", "no exact match — assign 0–3 manually"
MISSING, NO_BASELINE, PRESENT = "extracted missing", "extracted present; no historical baseline", "extracted present — assign 0–3 manually"
NAME_NOTE = "compare project_title to business.name — assign 0–3 manually"
HEADLINE_NOTE = "semantic — compare requirement text to recommendedHeadline"
LOGO_NOTE = "logo quality — manual review of top candidate vs production asset"
INSTRUCTIONS_NOTE = "mode B — instructions echoed; measure Claude influence manually"
REQUIREMENTS = "website_plus_requirements"


def _scored(score: str, method: str, notes: str) -> Column:
    return F.struct(F.lit(score).alias("score"), F.lit(method).alias("method"), F.lit(notes).alias("notes"))


def exact_outcome(expected: Column, found: Column) -> Column:
    """struct(score, method, notes): N/A without an expectation, 0 without a find, 3 if one holds the other, else for review."""
    e, f, x, y = trim(expected), trim(found), X.comparable(expected), X.comparable(found)
    return (
        F.when((e == "") & (f == ""), _scored("N/A", "missing", BOTH_EMPTY))
        .when(e == "", _scored("N/A", "missing", NO_HISTORY))
        .when(f == "", _scored("0", "missing", NOTHING_FOUND))
        .when(x.contains(y) | y.contains(x), _scored("3", "exact", MATCHED))
        .otherwise(_scored("review", "review", UNMATCHED))
    )


def present_outcome(expected: Column, found: Column) -> Column:
    return F.when(trim(found) == "", _scored("0", "missing", MISSING)).when(trim(expected) == "", _scored("review", "review", NO_BASELINE)).otherwise(_scored("review", "present", PRESENT))


def field_scores(runs: DataFrame) -> DataFrame:
    """The FIELD_SCORES rows of runs: six or seven fields of each success, one row for a run that was skipped, failed or dry.

    runs: run_id, ds_id, ds_number, website_url, mode, status, project_title, shop_code,
    first_req_description, first_req_note, skip_reason, error_message,
    customer_instructions, and response (JSON text). Null cells are blank.
    """
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    at = lambda path: trim(F.get_json_object("response", path))
    read = {
        "_ok": F.regexp_extract(at("$.ok"), "^(true|false)$", 1),
        "_name": at("$.business.name"),
        "_domain": at("$.business.domain"),
        "_headline": at("$.designIntake.recommendedHeadline"),
        "_logos": F.coalesce(F.json_array_length(F.get_json_object("response", "$.brand.logoCandidates")).cast("string"), F.lit("")),
        "_wanted": F.concat_ws(" | ", *(F.when(c(n) != "", c(n)) for n in ("first_req_description", "first_req_note"))),
    }
    read |= {"_of_ok": exact_outcome(F.lit("true"), read["_ok"]), "_of_domain": exact_outcome(c("shop_code"), read["_domain"])}
    ok, n_logos, wanted = F.col("_ok"), F.col("_logos"), F.col("_wanted")
    manual = lambda note: _scored("review", "review", note)

    def row(field: str, before: Column, found: Column, scored: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), before.alias("historical_value"), found.alias("extracted_value"), scored["score"].alias("score"), scored["method"].alias("score_method"), scored["notes"].alias("notes"))

    def whole(found: Column, method: str, notes: Column) -> Column:
        return F.array(F.struct(F.lit("_row").alias("field"), F.lit("").alias("historical_value"), found.alias("extracted_value"), F.lit("N/A").alias("score"), F.lit(method).alias("score_method"), notes.alias("notes")))

    fields = [
        row("extract.ok", F.lit("true"), ok, F.col("_of_ok")),
        row("business.name", c("project_title"), F.col("_name"), manual(NAME_NOTE)),
        row("business.domain", c("shop_code"), F.col("_domain"), F.col("_of_domain")),
        row("designIntake.recommendedHeadline", wanted, F.col("_headline"), manual(HEADLINE_NOTE)),
        row("brand.logoCandidates", F.lit(""), n_logos, present_outcome(F.lit(""), n_logos)),
        row("brand.logo", F.lit(""), F.when(n_logos != "", "candidates_present").otherwise(""), manual(LOGO_NOTE)),
    ]
    asked = row("customerInstructions", wanted, c("customer_instructions"), manual(INSTRUCTIONS_NOTE))
    status_ = F.col("status")
    rows = (
        F.when(status_ == "skipped", whole(F.lit(""), "skipped", F.coalesce("skip_reason", F.lit("skipped"))))
        .when(status_ == "dry_run", whole(c("error_message"), "skipped", F.lit("dry run — no extraction")))
        .when(status_ == "error", whole(c("error_message"), "missing", F.coalesce("error_message", F.lit("error"))))
        .when(F.col("mode") == REQUIREMENTS, F.array(*fields, asked))
        .otherwise(F.array(*fields))
    )
    head = [c(n).alias(n) for n in ("run_id", "ds_id", "ds_number", "website_url", "mode")]
    return runs.withColumns(read).select(*head, status_.alias("run_status"), F.explode(rows).alias("r")).select(*FIELD_SCORES[:6], "r.*")
