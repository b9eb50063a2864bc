"""The URL inventory: candidates with the review of their site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions import status
from webgrain.functions import url as U
from webgrain.functions.base import filled, trim
from webgrain.operators import merge
from webgrain.operators.presence import FIELDS

#: What an inventory row's state weighs, and the rank of its outcome.
PROCESSED, PER_RANK = 1_000_000, 500_000
#: Ranges that a total order is numbered in, and rows that their bounds are taken from.
RANGES, SAMPLE = 64, 6_400


def review_index(reviews: DataFrame, seq_col: str = "seq") -> DataFrame:
    """(domain_key, review): a row registers under the host of its URL and under its domain; the last row wins."""
    by_url = U.canonical_domain_or_null(filled(U.host_of(F.col("normalized_url"))))
    by_domain = U.domain_key(F.col("canonical_domain"), F.col("domain"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    keys = F.array_distinct(F.array_compact(F.array(by_url, by_domain)))
    rows = reviews.select(F.struct(*reviews.columns).alias("review"), F.col(seq_col).alias("_seq"), F.explode(keys).alias("domain_key"))
    return rows.groupBy("domain_key").agg(F.max_by("review", "_seq").alias("review"))


def _review_status(review: Column) -> Column:
    blank = trim(review["status"]) == ""
    return F.when(review.isNull(), "not_run").when(blank, "failed").otherwise(status.status(review["status"]))


def build_inventory(candidates: DataFrame, reviews: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Every candidate with original_index, extraction_status and the review of its host, if there is one.

    Two left joins on a side with one row for each key: by the URL's host, then
    by the domain columns. Spark broadcasts it if its bytes are few, else it splits
    the rows of frequent hosts.
    """
    index = review_index(reviews)
    by_url = U.canonical_domain_or_null(filled(U.host_of(F.col("normalized_url"))))
    by_domain = U.domain_key(F.col("canonical_domain"), F.col("domain"), F.col("normalized_url"), F.col("raw_url"))
    rows = candidates.withColumns({"_k1": by_url, "_k2": by_domain, "original_index": F.col(seq_col)})
    one = index.select(F.col("domain_key").alias("_k1"), F.col("review").alias("_r1"))
    two = index.select(F.col("domain_key").alias("_k2"), F.col("review").alias("_r2"))
    joined = rows.join(one, "_k1", "left").join(two, "_k2", "left").withColumn("review", F.coalesce("_r1", "_r2"))
    return joined.drop("_k1", "_k2", "_r1", "_r2").withColumn("extraction_status", _review_status(F.col("review")))


def row_score(inventory: DataFrame) -> Column:
    """Priority of an inventory row: its outcome, its review's own priority, a host without www."""
    have = {f.name for f in inventory.schema["review"].dataType.fields}
    cell = lambda n: F.col(f"review.{n}") if n in have else F.lit("")
    return (
        F.when(F.col("extraction_status") != "not_run", PROCESSED).otherwise(0)
        + status.outcome_rank(F.col("extraction_status")) * PER_RANK
        + F.when(F.col("review").isNotNull(), merge.row_priority(cell)).otherwise(0)
        + F.when(~U.is_www(F.col("domain")) & ~U.is_www(F.col("normalized_url")), 1).otherwise(0)
    )


def collapse_inventory(inventory: DataFrame) -> DataFrame:
    """One row of each site key, the best by priority, of equal ones the first; sources are united and hidden spellings counted.

    Taking row after row, a better row puts its sources before those so far, another
    one after them. So the rows that were the best so far stand in reverse, then the
    rest in order: a place for each row, of which each source takes the least.
    """
    key = U.site_key(F.col("canonical_domain"), F.col("domain"), F.col("normalized_url"), F.col("raw_url"))
    row = F.struct(*inventory.columns)
    rows = inventory.select(key.alias("site_key"), row.alias("row"), row_score(inventory).alias("score"), F.col("original_index").alias("i")).filter("site_key IS NOT NULL")
    best = rows.groupBy("site_key").agg(F.max_by("row", F.struct(F.col("score"), -F.col("i"))).alias("row"), F.min("i").alias("first_index"), F.count("*").alias("n_variants"))
    columns = [c for c in inventory.columns if c != "original_index"]
    if "source_column" in columns:
        before = Window.partitionBy("site_key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
        narrow = rows.select("site_key", "i", "score", F.col("row.source_column").alias("sources"))
        place = F.when(F.col("score") > F.coalesce(F.max("score").over(before), F.lit(-1)), -F.col("i")).otherwise(F.col("i"))
        tokens = F.posexplode(F.filter(F.transform(F.split(F.coalesce("sources", F.lit("")), ";"), trim), lambda x: x != ""))
        each = narrow.select("site_key", place.alias("place"), "sources").select("site_key", "place", tokens.alias("k", "source"))
        found = each.groupBy("site_key", "source").agg(F.min(F.struct("place", "k")).alias("at")).groupBy("site_key").agg(F.array_sort(F.collect_list(F.struct("at", "source"))).alias("found"))
        best = best.join(found, "site_key", "left").withColumn("united", F.coalesce(F.array_join(F.transform("found", lambda x: x["source"]), "; "), F.lit("")))
    chosen = (F.col("united").alias(c) if c == "source_column" else F.col(f"row.{c}").alias(c) for c in columns)
    return best.select("site_key", *chosen, F.col("first_index").alias("original_index"), (F.col("n_variants") - 1).alias("hidden_variants"))


def inventory_stats(raw: DataFrame, collapsed: DataFrame) -> DataFrame:
    """One row of counters."""
    s = F.col("extraction_status")
    counts = collapsed.agg(
        F.count("*").alias("n_rows"),
        F.count_if(s == "success").alias("n_success"),
        F.count_if(s == "failed").alias("n_failed"),
        F.count_if(s == "not_run").alias("n_not_run"),
        F.count_if(F.col("review").isNotNull()).alias("n_with_review"),
        F.count_distinct("canonical_domain").alias("n_domains"),
        F.coalesce(F.sum("hidden_variants"), F.lit(0)).alias("n_hidden"),
    )
    return raw.agg(F.count("*").alias("n_raw")).join(counts)


def _failed(review: str = "review.") -> Column:
    return (F.col("extraction_status") == "failed") | ((F.col("extraction_status") == "success") & ~(FIELDS["business_name"](review) & FIELDS["logos"](review) & FIELDS["colors"](review)))


def sort_rank(inventory: DataFrame, mode: str) -> DataFrame:
    """The inventory with rank, from 1, in one of five orders: recent, original, domain, status, needs_work.

    A total order of the viewer's table; for pages of it take orderBy and limit.
    Ranges of the order are numbered apart and moved by the counts of the ranges
    before them; their bounds come from a sample, the ranks from all rows.
    """
    recent = F.coalesce(status.sort_millis(F.col("review.processed_at"), F.col("review.extraction_run_id"), F.col("review.source_review_queue")), F.lit(0))
    first = {
        "recent": -recent,
        "original": F.lit(0),
        "domain": F.coalesce("canonical_domain", F.lit("")),
        "status": -status.outcome_rank(F.col("extraction_status")),
        "needs_work": F.when(_failed(), 0).otherwise(1),
    }[mode]
    keyed = inventory.withColumn("_by", F.struct(first.alias("a"), F.col("original_index").alias("b")))
    sample = keyed.select("_by").orderBy(F.xxhash64("_by"), "_by").limit(SAMPLE).orderBy("_by").collect()
    kind = keyed.schema["_by"].dataType.simpleString()
    bounds = [F.struct(F.lit(r["_by"]["a"]), F.lit(r["_by"]["b"])).cast(kind) for r in sample[:: -(-len(sample) // RANGES) or 1][1:]]
    range_of = F.lit(0)
    for bound in bounds:
        range_of = range_of + (F.col("_by") >= bound).cast("int")
    keyed = keyed.withColumn("_range", range_of)
    counts = keyed.groupBy("_range").agg(F.count("*").alias("n"))  # RANGES rows at most
    offsets = counts.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_by"))
    ranked = keyed.join(F.broadcast(offsets), "_range").withColumn("rank", (inside + F.col("_before")).cast("long"))
    return ranked.drop("_by", "_range", "_before")


def latest_batch(reviews: DataFrame) -> DataFrame:
    """Reviews with run_id and in_latest_batch: whether their run is the newest of the table."""
    run = F.coalesce(filled(F.col("extraction_run_id")), filled(status.run_id_of(F.col("source_review_queue"))))
    rows = reviews.withColumn("run_id", run)
    newest = rows.agg(F.max("run_id").alias("_newest"))
    return rows.join(F.broadcast(newest)).withColumn("in_latest_batch", F.coalesce(F.col("run_id") == F.col("_newest"), F.lit(False))).drop("_newest")
