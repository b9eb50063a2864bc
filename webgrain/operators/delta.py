"""Contact fields before and after a rerun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions import status
from webgrain.functions import url as U
from webgrain.functions.base import any_of
from webgrain.operators.presence import has_address, has_email, has_phone, has_social

FIELDS = {"email": has_email, "phone": has_phone, "address": has_address, "social": has_social}


def with_site_key(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("site_key", U.site_key(F.col("canonical_domain"), F.col("domain"), F.col("normalized_url"), F.lit(None).cast("string")))


def contact_delta(rerun: DataFrame, baseline: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Each rerun row against the last baseline row of its site: status before and after, change of each contact field.

    A row without a baseline row is compared with itself, and a rerun that failed
    changes nothing. still_missing: a field is empty afterwards.
    """
    flags = lambda df: df.select("site_key", F.struct(status.status(F.col("status")).alias("status"), *(has().alias(f) for f, has in FIELDS.items())).alias("f"), F.col(seq_col).alias("_seq"))
    old = flags(with_site_key(baseline)).groupBy("site_key").agg(F.max_by("f", "_seq").alias("before"))
    new = flags(with_site_key(rerun)).select("site_key", F.col("f").alias("after"))
    both = new.join(old, "site_key", "left")

    before = {f: F.when(F.col("before").isNull(), F.col(f"after.{f}")).otherwise(F.col(f"before.{f}")) for f in FIELDS}
    after = {f: F.when(F.col("after.status") == "success", F.col(f"after.{f}")).otherwise(before[f]) for f in FIELDS}

    def change(f: str) -> Column:
        return F.when(after[f] & ~before[f], "gained").when(before[f] & ~after[f], "lost").otherwise("unchanged")

    return both.select(
        "site_key",
        F.coalesce("before.status", F.lit("not_run")).alias("status_before"),
        F.col("after.status").alias("status_after"),
        *(change(f).alias(f) for f in FIELDS),
        any_of(*(~after[f] for f in FIELDS)).alias("still_missing"),
    )


def delta_counts(delta: DataFrame) -> DataFrame:
    gained = F.array_contains(F.array(*FIELDS), "gained")
    lost = F.array_contains(F.array(*FIELDS), "lost")
    return delta.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("status_after") == "success").alias("n_success"),
        F.count_if(F.col("status_after") == "failed").alias("n_failed"),
        F.count_if(F.col("status_before") == "success").alias("n_success_before"),
        *(F.count_if(F.col(f) == how).alias(f"{f}_{how}") for f in FIELDS for how in ("gained", "lost")),
        F.count_if(gained).alias("n_any_gained"),
        F.count_if(~gained & ~lost).alias("n_unchanged"),
        F.count_if(lost).alias("n_lost"),
        F.count_if(~gained & ~lost & F.col("still_missing")).alias("n_still_missing"),
    )


def examples(delta: DataFrame, kind: str, most: int = 10) -> DataFrame:
    """The first sites, by key, in which a field was gained or lost."""
    hit = delta.filter(F.array_contains(F.array(*FIELDS), kind)).orderBy("site_key").limit(most)
    return hit.withColumn("rank", F.row_number().over(Window.orderBy("site_key")).cast("long"))


def baseline_before(runs: DataFrame, run_id: str) -> DataFrame:
    """The newest run before the given one, as one row."""
    return runs.filter(F.col("run_id") < run_id).orderBy(F.desc("run_id")).limit(1)
