"""Queries on reviews: status, merging, inventory, coverage, scores, deltas, publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.functions import status
from webgrain.operators import coverage, delta, inventory, merge, publish, scores
from webgrain.operators import presence as P
from webgrain.plans import inputs as I
from webgrain.plans import url_sql as S
from webgrain.plans.merge_sql import MERGE_SQL

_STATUS = """CASE WHEN {0} IN ('', 'not_run', 'pending', 'missing', 'no_data_yet', 'no_data', 'blank') THEN 'not_run'
  WHEN {0} IN ('success', 'ok', 'completed') THEN 'success' ELSE 'failed' END"""


def _status(x: str) -> str:
    return _STATUS.format(rf"regexp_replace(lower(trim({x})), '\s+', '_', 'g')")


_HAS = {
    "business_name": "extracted_business_name <> ''",
    "logos": "(selected_logo_url <> '' OR logo_candidate_count = '1')",
    "colors": "(extracted_color_hexes <> '' OR primary_color_hex <> '')",
    "emails": "extracted_emails <> ''",
    "phones": "extracted_phone_numbers <> ''",
    "social": "extracted_social_links <> ''",
    "address": "extracted_addresses <> ''",
    "products_services": "extracted_services <> ''",
    "summary": "extracted_summary <> ''",
}
_R = f"r AS ({I.sql(I.REVIEWS)})"
_KEY = S.site_key("canonical_domain", "domain", "normalized_url", "''")
_PCT = "CAST(CASE WHEN {1} > 0 THEN floor(100.0 * {0} / {1} + 0.5) ELSE 0 END AS BIGINT)"


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.derive(spark, sf_dir, I.REVIEWS)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("event_type").agg(F.first(status.status(F.col("event_type"))).alias("status"), F.count("*").alias("n"))


def review_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.count_by_status(_reviews(spark, sf_dir))


def merge_best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.best_attempt(_reviews(spark, sf_dir), merge.attempt_key()).select("attempt_key", "seq", "status", "processed_at", "n_attempts")


def merge_full_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_attempts(_reviews(spark, sf_dir)).drop("project_type", "shop_code")


def inventory_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = inventory.build_inventory(I.derive(spark, sf_dir, I.CANDIDATES), _reviews(spark, sf_dir))
    return inv.select("seq", "extraction_status", F.col("review.seq").alias("review_seq"))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.build_inventory(I.derive(spark, sf_dir, I.CANDIDATES), _reviews(spark, sf_dir))


def inventory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _inventory(spark, sf_dir)
    return inventory.inventory_stats(raw, inventory.collapse_inventory(raw))


def inventory_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.collapse_inventory(_inventory(spark, sf_dir)).select("site_key", "seq", "original_index", "extraction_status", "hidden_variants", "source_column")


def _sorted(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inventory.sort_rank(_inventory(spark, sf_dir), mode).select("seq", "rank")

    return run


_INV = f"""{_R}, b AS (SELECT * FROM r),
  k AS (SELECT unnest(list_distinct([{S.canonical(S.host_of("normalized_url"))}, {S.domain_key("canonical_domain", "domain", "''", "''")}])) AS domain_key, b.* FROM b),
  i AS (SELECT * FROM k WHERE domain_key IS NOT NULL AND domain_key <> '' QUALIFY row_number() OVER (PARTITION BY domain_key ORDER BY seq DESC) = 1),
  c AS ({I.sql(I.CANDIDATES)}),
  j AS (SELECT c.*, coalesce(x.seq, y.seq) AS review_seq FROM c LEFT JOIN i x ON x.domain_key = nullif({S.canonical(S.host_of("c.normalized_url"))}, '')
    LEFT JOIN i y ON y.domain_key = {S.domain_key("c.canonical_domain", "c.domain", "c.normalized_url", "c.raw_url")}),
  inv AS (SELECT j.*, CASE WHEN review_seq IS NULL THEN 'not_run' WHEN b.status = '' THEN 'failed' ELSE {_status("b.status")} END AS extraction_status,
      b.processed_at, b.extracted_business_name, b.selected_logo_url, b.logo_candidate_count, b.extracted_color_hexes, b.primary_color_hex,
      CASE b.status WHEN 'success' THEN 1500000 WHEN '' THEN 0 ELSE 1200000 END + 1000 * ({" + ".join(f"CAST(b.{c} <> '' AS INT)" for c in merge.COUNTED if c in I.REVIEWS)})
        + CASE WHEN regexp_matches(b.domain, '^(?i)(https?://)?www[.]') OR regexp_matches(b.normalized_url, '^(?i)(https?://)?www[.]') THEN 0 ELSE 1 END AS review_priority
    FROM j LEFT JOIN b ON b.seq = j.review_seq)"""

_COLLAPSED = f"""{_INV}, scored AS (
    SELECT *, {S.site_key("canonical_domain", "domain", "normalized_url", "raw_url")} AS site_key,
      CASE WHEN extraction_status <> 'not_run' THEN 1000000 ELSE 0 END + 500000 * CASE extraction_status WHEN 'success' THEN 3 WHEN 'failed' THEN 2 ELSE 1 END
      + coalesce(epoch_ms(CAST(replace(replace(processed_at, 'T', ' '), 'Z', '') AS TIMESTAMP)) + review_priority, 0)
      + CASE WHEN regexp_matches(domain, '^(?i)(https?://)?www[.]') OR regexp_matches(normalized_url, '^(?i)(https?://)?www[.]') THEN 0 ELSE 1 END AS score FROM inv
  ), col AS (
    SELECT site_key, seq, extraction_status, review_seq, canonical_domain, source_column, score, min(seq) OVER (PARTITION BY site_key) AS original_index, count(*) OVER (PARTITION BY site_key) - 1 AS hidden_variants,
      row_number() OVER (PARTITION BY site_key ORDER BY score DESC, seq) AS nr FROM scored WHERE site_key IS NOT NULL
  ), collapsed AS (SELECT * FROM col WHERE nr = 1),
  step AS (SELECT site_key, source_column, seq, score > coalesce(max(score) OVER (PARTITION BY site_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_best FROM col),
  united AS (SELECT site_key, string_agg(source_column, '; ' ORDER BY place) AS sources FROM (SELECT site_key, source_column, min(CASE WHEN is_best THEN -seq ELSE seq END) AS place FROM step WHERE source_column <> '' GROUP BY ALL) GROUP BY site_key)"""

_ORDERS = {
    "recent": "coalesce(processed_at, '') DESC, seq",
    "original": "seq",
    "domain": "canonical_domain, seq",
    "status": "CASE extraction_status WHEN 'success' THEN 3 WHEN 'failed' THEN 2 ELSE 1 END DESC, seq",
    "needs_work": f"(extraction_status = 'failed' OR (extraction_status = 'success' AND NOT ({_HAS['business_name']} AND {_HAS['logos']} AND {_HAS['colors']}))) DESC, seq",
}


def viewer_query_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviews(spark, sf_dir)
    return rows.filter(P.matches_filters(["has_logos", "missing_emails"]) & P.matches_search("TH", ["domain", "extracted_business_name"])).select("seq", "domain")


def coverage_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.field_coverage(_reviews(spark, sf_dir))


def scrape_depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.scrape_depth(_reviews(spark, sf_dir), status.pages_inspected(F.col("pages_inspected")))


#: Runs from here on are not yet in the earlier snapshot.
_SECOND_RUNS = "20240106"


def coverage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviews(spark, sf_dir)
    return coverage.compare_snapshots(coverage.snapshot(rows.filter(f"extraction_run_id < '{_SECOND_RUNS}'"), "a"), coverage.snapshot(rows, "b"))


def palette_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.palette_diagnostics(_reviews(spark, sf_dir))


def missing_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.missing_contact(_reviews(spark, sf_dir))


def key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.key_coverage(_reviews(spark, sf_dir))


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.score_distribution(_reviews(spark, sf_dir), ["overall_score", "brief_score"])


def score_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = scores.score_averages(_reviews(spark, sf_dir), ["overall_score", "brief_score"])
    return means.select("score", F.round("average", 6).alias("average"))


def top_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.top_notes(_reviews(spark, sf_dir))


def contact_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviews(spark, sf_dir)
    return delta.contact_delta(rows.filter("seq % 2 = 1"), rows.filter("seq % 2 = 0"))


def contact_delta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.delta_counts(contact_delta(spark, sf_dir))


def publish_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = publish.sanitize_reviews(_reviews(spark, sf_dir))
    return out.select("seq", "domain", "normalized_url", "status", "error_message", "extracted_business_name", "processed_at")


def publish_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.collapse_published(publish.sanitize_reviews(_reviews(spark, sf_dir))).select("normalized_url", "seq", "status", "source_review_queue", "n_rows")


_SUCCESS = "status = 'success'"
_KIND = """CASE WHEN lower(trim({0})) = '' THEN 'blank' WHEN lower(trim({0})) = 'n/a' THEN 'na' WHEN trim({0}) IN ('0', '1', '2', '3') THEN trim({0}) ELSE 'invalid' END"""
_BUCKET = "CASE WHEN p <= 0 THEN '0' WHEN p <= 3 THEN CAST(p AS VARCHAR) WHEN p <= 5 THEN '4-5' ELSE '6+' END"


def _field_rows(where: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT {i} AS position, '{f}' AS field, (SELECT count(*) FROM r WHERE {where} AND {_SUCCESS} AND {has}) AS n, (SELECT count(*) FROM r WHERE {where} AND {_SUCCESS}) AS total"
        for i, (f, has) in enumerate(_HAS.items())
    )
    return f"SELECT *, {_PCT.format('n', 'total')} AS pct FROM ({each})"


def _depth_rows(where: str) -> str:
    labels = ", ".join(f"({i}, '{b}')" for i, b in enumerate(status.DEPTH_BUCKETS))
    return f"""SELECT l.position, l.bucket, coalesce(h.n, 0) AS n, {_PCT.format("coalesce(h.n, 0)", f"(SELECT count(*) FROM r WHERE {where})")} AS pct
      FROM (VALUES {labels}) l(position, bucket) LEFT JOIN (SELECT {_BUCKET} AS bucket, count(*) AS n FROM (SELECT CAST(pages_inspected AS INTEGER) AS p FROM r WHERE {where}) GROUP BY 1) h USING (bucket)"""


def _snapshot(where: str) -> str:
    return f"SELECT field AS metric, pct FROM ({_field_rows(where)}) UNION ALL SELECT 'pages_' || bucket, pct FROM ({_depth_rows(where)})"


_FLAGS = {"email": "emails", "phone": "phones", "address": "address", "social": "social"}
_DELTA = f"""{_R}, x AS (SELECT *, {_KEY} AS site_key, {_status("status")} AS st FROM r),
  old AS (SELECT * FROM x WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY seq DESC) = 1),
  d AS (SELECT n.site_key, coalesce(o.st, 'not_run') AS status_before, n.st AS status_after, NOT ({" AND ".join(f"CASE WHEN n.st = 'success' OR o.seq IS NULL THEN n.{_HAS[g]} ELSE o.{_HAS[g]} END" for g in _FLAGS.values())}) AS still_missing, {", ".join(
    f"CASE WHEN o.seq IS NULL OR n.st <> 'success' OR {has_n} = {has_o} THEN 'unchanged' WHEN {has_n} THEN 'gained' ELSE 'lost' END AS {f}"
    for f, (has_n, has_o) in ((f, (f"(n.{_HAS[g]})", f"(o.{_HAS[g]})")) for f, g in _FLAGS.items())
  )} FROM (SELECT * FROM x WHERE seq % 2 = 1) n LEFT JOIN old o USING (site_key))"""
_ANY = {how: "(" + " OR ".join(f"{f} = '{how}'" for f in _FLAGS) + ")" for how in ("gained", "lost")}

QUERIES = {
    "status_normalize_counts": status_counts,
    "review_status_counts": review_status_counts,
    "merge_best_attempt": merge_best_attempt,
    "merge_full_fold": merge_full_fold,
    "inventory_left_join": inventory_left_join,
    "inventory_collapse": inventory_collapse,
    "inventory_stats": inventory_stats,
    **{f"inventory_sort_{mode}": _sorted(mode) for mode in _ORDERS},
    "viewer_query_filters": viewer_query_filters,
    "coverage_fields": coverage_fields,
    "coverage_delta": coverage_delta,
    "scrape_depth_histogram": scrape_depth_histogram,
    "palette_diagnostics": palette_diagnostics,
    "missing_contact": missing_contact,
    "key_coverage": key_coverage,
    "score_distribution": score_distribution,
    "score_averages": score_averages,
    "top_notes": top_notes,
    "contact_delta": contact_delta,
    "contact_delta_counts": contact_delta_counts,
    "publish_sanitize": publish_sanitize,
    "publish_collapse": publish_collapse,
}

_FILLED = [c for c in merge.FILLED if c in I.REVIEWS]
_HOST = S.domain_key("canonical_domain", "domain", "normalized_url", "''")
SQL = {
    "merge_full_fold": MERGE_SQL,
    "status_normalize_counts": f"SELECT event_type, {_status('event_type')} AS status, count(*) AS n FROM events GROUP BY event_type",
    "review_status_counts": f"WITH {_R} SELECT " + ", ".join(f"count(*) FILTER ({_status('status')} = '{v}') AS {v}" for v in ("success", "failed", "not_run")) + " FROM r",
    "merge_best_attempt": f"""WITH {_R}, x AS (SELECT *, {_KEY} AS attempt_key, CASE {_status("status")} WHEN 'success' THEN 3 WHEN 'failed' THEN 2 ELSE 1 END AS o,
      {" + ".join(f"CASE WHEN trim({c}) <> '' THEN 1 ELSE 0 END" for c in _FILLED)} AS filled,
      CASE WHEN regexp_matches(domain, '^(?i)(https?://)?www[.]') OR regexp_matches(normalized_url, '^(?i)(https?://)?www[.]') THEN 1 ELSE 0 END AS www FROM r)
      SELECT attempt_key, seq, status, processed_at, n_attempts FROM (
        SELECT *, count(*) OVER (PARTITION BY attempt_key) AS n_attempts, row_number() OVER (PARTITION BY attempt_key ORDER BY o DESC, processed_at DESC, filled DESC, www, seq) AS nr FROM x
      ) WHERE nr = 1""",
    "inventory_left_join": f"WITH {_INV} SELECT seq, extraction_status, review_seq FROM inv",
    "inventory_collapse": f"WITH {_COLLAPSED} SELECT site_key, seq, original_index, extraction_status, hidden_variants, coalesce(sources, '') AS source_column FROM collapsed LEFT JOIN united USING (site_key)",
    "inventory_stats": f"""WITH {_COLLAPSED} SELECT (SELECT count(*) FROM inv) AS n_raw, count(*) AS n_rows, count(*) FILTER (extraction_status = 'success') AS n_success,
      count(*) FILTER (extraction_status = 'failed') AS n_failed, count(*) FILTER (extraction_status = 'not_run') AS n_not_run, count(review_seq) AS n_with_review,
      count(DISTINCT canonical_domain) AS n_domains, CAST(coalesce(sum(hidden_variants), 0) AS BIGINT) AS n_hidden FROM collapsed""",
    **{f"inventory_sort_{m}": f"WITH {_INV} SELECT seq, row_number() OVER (ORDER BY {o}) AS rank FROM inv" for m, o in _ORDERS.items()},
    "viewer_query_filters": f"WITH {_R} SELECT seq, domain FROM r WHERE {_HAS['logos']} AND extracted_emails = '' AND {_status('status')} <> 'not_run' AND contains(lower(domain || ' ' || extracted_business_name), 'th')",
    "coverage_fields": f"WITH {_R} SELECT *, CASE WHEN pct >= 80 THEN 'strong' WHEN pct < 50 THEN 'weak' ELSE '' END AS verdict FROM ({_field_rows('TRUE')})",
    "scrape_depth_histogram": f"WITH {_R} {_depth_rows('TRUE')}",
    "coverage_delta": f"""WITH {_R}, a AS ({_snapshot(f"extraction_run_id < '{_SECOND_RUNS}'")}), b AS ({_snapshot("TRUE")}), d AS (SELECT metric, a.pct AS pct_before, b.pct AS pct_after, b.pct - a.pct AS delta FROM b JOIN a USING (metric))
      SELECT *, concat(metric, ': ', pct_before, '% → ', pct_after, '% (', CASE WHEN delta > 0 THEN '+' ELSE '' END, delta, ' pts)') AS text, row_number() OVER (ORDER BY abs(delta) DESC, list_position({coverage.METRICS}, metric)) AS rank FROM d""",
    "palette_diagnostics": f"WITH {_R} SELECT count(*) FILTER ({_HAS['colors']}) AS with_colors, count(*) FILTER (palette_source <> '') AS with_source, count(*) FILTER ({_HAS['colors']} AND palette_source = '') AS colors_without_source FROM r WHERE {_SUCCESS}",
    "missing_contact": f"WITH {_R} SELECT count(*) AS total, "
    + ", ".join(f"count(*) FILTER (NOT ({_HAS[f]})) AS missing_{f}" for f in ("emails", "phones", "address", "social"))
    + f", count(*) FILTER (NOT ({' OR '.join(_HAS[f] for f in ('emails', 'phones', 'address', 'social'))})) AS missing_all FROM r WHERE {_SUCCESS}",
    "key_coverage": f"WITH {_R} SELECT count(*) AS total, count(*) FILTER (ds_number <> '') AS with_key, count(*) FILTER (ds_number = '') AS without_key FROM r",
    "score_distribution": f"WITH {_R} " + " UNION ALL ".join(f"SELECT '{c}' AS score, '{k}' AS kind, count(*) FILTER ({_KIND.format(c)} = '{k}') AS n FROM r" for c in ("overall_score", "brief_score") for k in scores.KINDS),
    "score_averages": f"WITH {_R} " + " UNION ALL ".join(f"SELECT '{c}' AS score, round(avg(CASE WHEN {_KIND.format(c)} IN ('0', '1', '2', '3') THEN CAST({c} AS DOUBLE) END), 6) AS average FROM r" for c in ("overall_score", "brief_score")),
    "top_notes": f"WITH {_R} SELECT note, n, row_number() OVER (ORDER BY n DESC, note) AS rank FROM (SELECT reviewer_notes AS note, count(*) AS n FROM r WHERE reviewer_notes <> '' GROUP BY 1) ORDER BY n DESC, note LIMIT 5",
    "contact_delta": f"WITH {_DELTA} SELECT * FROM d",
    "contact_delta_counts": f"WITH {_DELTA} SELECT count(*) AS n_rows, count(*) FILTER (status_after = 'success') AS n_success, count(*) FILTER (status_after = 'failed') AS n_failed, count(*) FILTER (status_before = 'success') AS n_success_before, "
    + ", ".join(f"count(*) FILTER ({f} = '{how}') AS {f}_{how}" for f in _FLAGS for how in ("gained", "lost"))
    + f", count(*) FILTER ({_ANY['gained']}) AS n_any_gained, count(*) FILTER (NOT {_ANY['gained']} AND NOT {_ANY['lost']}) AS n_unchanged, count(*) FILTER ({_ANY['lost']}) AS n_lost"
    + f", count(*) FILTER (NOT {_ANY['gained']} AND NOT {_ANY['lost']} AND still_missing) AS n_still_missing FROM d",
    "publish_sanitize": rf"""WITH {_R} SELECT seq, {_HOST} AS domain, 'https://' || {_HOST} AS normalized_url, status,
      trim(regexp_replace(regexp_replace(error_message, '(?i)https?://[^\s)]+', '[url]', 'g'), '(?i)[a-z0-9-]+\.(com|net|org|io)/[^\s)]+', '[path]', 'g')) AS error_message, extracted_business_name, processed_at FROM r""",
    "publish_collapse": f"""WITH {_R}, p AS (SELECT *, 'https://' || {_HOST} AS u, CASE {_status("status")} WHEN 'success' THEN 3 WHEN 'failed' THEN 2 ELSE 1 END AS o FROM r),
      f AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY o DESC, seq) AS nr, count(*) OVER (PARTITION BY u) AS n_rows, first_value(source_review_queue) OVER (PARTITION BY u ORDER BY seq) AS q FROM p)
      SELECT u AS normalized_url, seq, status, q AS source_review_queue, n_rows FROM f WHERE nr = 1""",
}
