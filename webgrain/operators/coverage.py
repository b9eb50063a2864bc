"""Field coverage, scrape depth, snapshots and their deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions import status
from webgrain.functions.base import percent, trim
from webgrain.operators.presence import FIELDS

STRONG, WEAK = 80, 50
#: The metrics of a snapshot, in order.
METRICS = [*FIELDS, *(f"pages_{b}" for b in status.DEPTH_BUCKETS)]


def _is_success() -> Column:
    return F.trim(F.coalesce("status", F.lit(""))) == "success"


def field_coverage(reviews: DataFrame) -> DataFrame:
    """A row for each field: n, of successful rows, pct, and strong, weak or ''. One pass over the reviews."""
    counts = reviews.filter(_is_success()).agg(F.count("*").alias("total"), *(F.count_if(has()).alias(f) for f, has in FIELDS.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(f).alias("field"), F.col(f).alias("n")) for i, f in enumerate(FIELDS))))
    each = counts.select("total", rows.alias("r")).select("r.position", "r.field", "r.n", "total", percent(F.col("r.n"), F.col("total")).alias("pct"))
    return each.withColumn("verdict", F.when(F.col("pct") >= STRONG, "strong").when(F.col("pct") < WEAK, "weak").otherwise(""))


def scrape_depth(rows: DataFrame, pages: Column) -> DataFrame:
    """Rows by number of pages, in six buckets, also those without rows."""
    counts = rows.groupBy(status.depth_bucket(pages).alias("bucket")).agg(F.count("*").alias("n"))
    labels = rows.sparkSession.createDataFrame([(i, b) for i, b in enumerate(status.DEPTH_BUCKETS)], "position int, bucket string")
    total = rows.agg(F.count("*").alias("total"))
    n = F.coalesce("n", F.lit(0))
    return F.broadcast(labels).join(counts, "bucket", "left").join(F.broadcast(total)).select("position", "bucket", n.alias("n"), percent(n, F.col("total")).alias("pct"))


def snapshot(reviews: DataFrame, snapshot_id: str) -> DataFrame:
    """(snapshot_id, metric, n, pct) for all fields and depth buckets."""
    fields = field_coverage(reviews).select(F.lit(snapshot_id).alias("snapshot_id"), "field", "n", "pct")
    depth = scrape_depth(reviews, status.pages_inspected(F.col("pages_inspected")))
    return fields.unionByName(depth.select(F.lit(snapshot_id).alias("snapshot_id"), F.concat(F.lit("pages_"), "bucket").alias("field"), "n", "pct")).withColumnRenamed("field", "metric")


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, pct_before, pct_after, delta, text); the largest changes have the lowest rank, ties in the order of METRICS."""
    b = before.select("metric", F.col("pct").alias("pct_before"))
    a = after.select("metric", F.col("pct").alias("pct_after"))
    rows = a.join(b, "metric").withColumn("delta", F.col("pct_after") - F.col("pct_before"))
    sign = F.when(F.col("delta") > 0, "+").otherwise("")
    text = F.concat("metric", F.lit(": "), "pct_before", F.lit("% → "), "pct_after", F.lit("% ("), sign, "delta", F.lit(" pts)"))
    rank = F.row_number().over(Window.orderBy(F.abs("delta").desc(), F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric"))))
    return rows.select("metric", "pct_before", "pct_after", "delta", text.alias("text"), rank.cast("long").alias("rank"))


def snapshot_deltas(snapshots: DataFrame, order_col: str = "taken_at") -> DataFrame:
    """Each snapshot's metrics with the change against the snapshot before it."""
    before = F.lag("pct").over(Window.partitionBy("metric").orderBy(order_col))
    return snapshots.withColumn("delta", F.col("pct") - before)


def count_by_status(rows: DataFrame, column: str = "status") -> DataFrame:
    s = status.status(F.col(column))
    return rows.agg(*(F.count_if(s == v).alias(v) for v in ("success", "failed", "not_run")))


def palette_diagnostics(reviews: DataFrame) -> DataFrame:
    """Successful rows with colours, with a palette source, and with colours but no source."""
    colors, source = FIELDS["colors"](), trim(F.col("palette_source")) != ""
    return reviews.filter(_is_success()).agg(
        F.count_if(colors).alias("with_colors"), F.count_if(source).alias("with_source"), F.count_if(colors & ~source).alias("colors_without_source")
    )


def key_coverage(rows: DataFrame, column: str = "ds_number") -> DataFrame:
    has = trim(F.col(column)) != ""
    return rows.agg(F.count("*").alias("total"), F.count_if(has).alias("with_key"), F.count_if(~has).alias("without_key"))


def missing_contact(reviews: DataFrame) -> DataFrame:
    """Successful rows that lack e-mail, phone, address, social links, or all of them."""
    lacks = {f: ~FIELDS[f]() for f in ("emails", "phones", "address", "social")}
    every = lacks["emails"] & lacks["phones"] & lacks["address"] & lacks["social"]
    return reviews.filter(_is_success()).agg(F.count("*").alias("total"), *(F.count_if(c).alias(f"missing_{f}") for f, c in lacks.items()), F.count_if(every).alias("missing_all"))
