"""Queries on URLs: normalising, keys, priority, dedup, mining, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.functions import url as U
from webgrain.operators import mining
from webgrain.operators.dedup import dedupe_candidates
from webgrain.operators.selection import Options, select_batch
from webgrain.plans import inputs as I
from webgrain.plans import url_sql as S



def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derive(spark, sf_dir, I.CANDIDATES)
    return rows.select("seq", U.normalize(F.col("raw_url")).alias("u"))


def url_site_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derive(spark, sf_dir, I.CANDIDATES)
    c = [F.col(n) for n in ("canonical_domain", "domain", "normalized_url", "raw_url")]
    return rows.select("seq", U.site_key(*c).alias("site_key"), U.domain_key(*c).alias("domain_key"), U.is_www(F.col("domain")).alias("is_www"))


def url_path_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derive(spark, sf_dir, I.CANDIDATES)
    return rows.select("seq", U.path_type(F.col("raw_url")).alias("path_type"), U.priority(F.col("raw_url")).alias("priority"))


def url_dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: candidates, one of each normalised URL, sources united."""
    return dedupe_candidates(I.derive(spark, sf_dir, I.CANDIDATES)).select("url_key", "seq", "source_column", "n_rows")


_KEYED = f"""c AS ({I.sql(I.CANDIDATES)}),
  k1 AS ({S.normalized("c", "normalized_url", "seq")}), k2 AS ({S.normalized("c", "raw_url", "seq")}), k3 AS ({S.normalized("c", "domain", "seq")}),
  keyed AS (SELECT c.*, coalesce(k1.u, k2.u, k3.u) AS url_key FROM c JOIN k1 USING (seq) JOIN k2 USING (seq) JOIN k3 USING (seq))"""

_DEDUPED = f"""{_KEYED},
  s AS (SELECT url_key, source_column, min(seq) AS at_seq FROM keyed WHERE url_key IS NOT NULL GROUP BY ALL),
  u AS (SELECT url_key, string_agg(source_column, '; ' ORDER BY at_seq, source_column) AS sources FROM s GROUP BY url_key),
  f AS (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY seq) AS nr, count(*) OVER (PARTITION BY url_key) AS n_rows FROM keyed WHERE url_key IS NOT NULL),
  deduped AS (SELECT f.* EXCLUDE (source_column, nr), u.sources AS source_column FROM f JOIN u USING (url_key) WHERE nr = 1)"""


def mine_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.mine_candidates(I.derive(spark, sf_dir, I.EXPORT))
    return found.select("seq", "normalized_url", "raw_url", "source_column", "domain")


def mining_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    export = I.derive(spark, sf_dir, I.EXPORT)
    return mining.mining_summary(export, mining.mine_candidates(export))


_TLDS = "com|org|net|co|io|edu|gov|us|uk|ca|au|de|fr|biz|info|shop|store|app|dev|ai|me|tv|cc|xyz"
_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def _finds(column: str) -> str:
    email = rf"(?i)\b[a-z0-9._%+-]+@{_LABEL}(?:\.{_LABEL})+\b"
    masked = rf"""regexp_replace(regexp_replace({column}, '(?i)https?://[^\s<>"'']+', ' ', 'g'), '{email}', ' ', 'g')"""
    www, bare = (rf"regexp_extract_all({masked}, '(?i)\b{w}{_LABEL}\.(?:{_TLDS})\b')" for w in (r"www\.", ""))
    http = rf"""regexp_extract_all({column}, '(?i)https?://[^\s<>"'']+')"""
    return f"list_concat({http}, list_concat({www}, [d for d in {bare} if NOT list_contains({www}, d) AND regexp_matches(d, '(?i)[a-z][a-z0-9-]*[.][a-z]+$') AND NOT regexp_matches(d, '(?i)^www[.][a-z]+$')]))"


_MINED = rf"""e AS ({I.sql(I.EXPORT)}),
  finds AS (
    SELECT seq, 'first_req_description' AS source, 1 AS col, unnest({_finds("first_req_description")}) AS raw_url, generate_subscripts({_finds("first_req_description")}, 1) AS nr FROM e
    UNION ALL SELECT seq, 'first_req_note', 2, unnest({_finds("first_req_note")}), generate_subscripts({_finds("first_req_note")}, 1) FROM e
    UNION ALL SELECT seq, 'website_url', 3, website_url, 1 FROM e WHERE website_url <> ''
  ), w AS (SELECT *, {S.with_scheme(S.stripped("raw_url"))} AS href FROM finds),
  n AS (
    SELECT seq, source, col, nr, raw_url, lower({S.part("href", 2)}) AS domain, lower({S.part("href", 1)}) || '://' || lower({S.part("href", 2)}) || {S.part("href", 3)}
      || CASE WHEN {S.part("href", 4)} = '' THEN '/' ELSE {S.part("href", 4)} END || {S.part("href", 5)} || {S.part("href", 6)} AS normalized_url
    FROM w WHERE regexp_matches(href, '{S.PARTS}')
  ), srcs AS (SELECT seq, normalized_url, source, min(col) AS col FROM n GROUP BY ALL),
  u AS (SELECT seq, normalized_url, string_agg(source, '; ' ORDER BY col) AS source_column FROM srcs GROUP BY ALL),
  f AS (SELECT *, row_number() OVER (PARTITION BY seq, normalized_url ORDER BY col, nr) AS first FROM n),
  mined AS (SELECT f.seq, f.normalized_url, f.raw_url, u.source_column, f.domain FROM f JOIN u USING (seq, normalized_url) WHERE f.first = 1)"""


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.derive(spark, sf_dir, I.REVIEWS)


def _batch(options: Options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        picked = select_batch(I.derive(spark, sf_dir, I.CANDIDATES), _reviews(spark, sf_dir), options)
        return picked.select("rank", "url_key", "seq", "status", "path_type", "priority")

    return run


BATCHES = {
    "select_batch_default": (Options(limit=20, offset=5), "status = 'not_run'"),
    "select_batch_retry_failed": (Options(limit=40, retry_failed=True), "status IN ('not_run', 'failed')"),
    "select_batch_reprocess": (Options(limit=60, reprocess=True, root_first=False), "TRUE"),
    "select_batch_root_only": (Options(limit=30, reprocess=True, root_only=True, allow_duplicate_domains=True), "path_type = 'root'"),
    "select_batch_missing_colors": (Options(limit=50, missing_colors=True), "(status = 'not_run' OR (status = 'success' AND has_logo AND NOT has_colors))"),
    "select_batch_missing_contact": (Options(limit=50, missing_contact=("email", "phone")), "(status = 'success' AND (extracted_emails = '' OR extracted_phone_numbers = ''))"),
}


def _batch_sql(o: Options, where: str) -> str:
    order = "priority, seq, url_key" if o.root_first else "seq, url_key"
    pool = "deduped" if o.allow_duplicate_domains else "(SELECT * FROM deduped QUALIFY canonical_domain = '' OR row_number() OVER (PARTITION BY canonical_domain ORDER BY seq) = 1)"
    url = "coalesce(nullif(trim(normalized_url), ''), raw_url)"
    return f"""
WITH {_DEDUPED}, r AS ({I.sql(I.REVIEWS)}),
  x AS (SELECT *, {S.site_key("canonical_domain", "domain", "normalized_url", "''")} AS site_key FROM r),
  i AS (SELECT site_key, CASE WHEN status = 'success' THEN 'success' ELSE 'failed' END AS processed, extracted_emails, extracted_phone_numbers,
      selected_logo_url <> '' AS has_logo, extracted_color_hexes <> '' OR primary_color_hex <> '' AS has_colors
    FROM x QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY seq DESC) = 1),
  c2 AS (SELECT *, {S.site_key("canonical_domain", "domain", "normalized_url", "raw_url")} AS site_key, {S.path_type(url)} AS path_type, {S.priority(url)} AS priority FROM {pool}),
  j AS (SELECT c2.*, coalesce(i.processed, 'not_run') AS status, i.* EXCLUDE (site_key, processed) FROM c2 LEFT JOIN i USING (site_key)),
  ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM j WHERE {where})
SELECT rank, url_key, seq, status, path_type, priority FROM ranked WHERE rank > {o.offset} AND rank <= {o.offset + o.limit}"""


QUERIES = {
    "url_dedupe_first_wins": url_dedupe_first_wins,
    "url_normalize": url_normalize,
    "url_site_keys": url_site_keys,
    "url_path_priority": url_path_priority,
    "mine_urls": mine_urls,
    "mining_summary": mining_summary,
    **{name: _batch(o) for name, (o, _) in BATCHES.items()},
}

SQL = {
    "url_dedupe_first_wins": f"WITH {_DEDUPED} SELECT url_key, seq, source_column, n_rows FROM deduped",
    "url_normalize": f"WITH c AS ({I.sql(I.CANDIDATES)}) {S.normalized('c', 'raw_url', 'seq')}",
    "url_site_keys": f"""WITH c AS ({I.sql(I.CANDIDATES)}) SELECT seq, {S.site_key("canonical_domain", "domain", "normalized_url", "raw_url")} AS site_key,
      {S.domain_key("canonical_domain", "domain", "normalized_url", "raw_url")} AS domain_key, regexp_matches(domain, '^(?i)(https?://)?www[.]') AS is_www FROM c""",
    "url_path_priority": f"WITH c AS ({I.sql(I.CANDIDATES)}) SELECT seq, {S.path_type('raw_url')} AS path_type, {S.priority('raw_url')} AS priority FROM c",
    "mine_urls": f"WITH {_MINED} SELECT * FROM mined",
    "mining_summary": f"""WITH {_MINED} SELECT (SELECT count(*) FROM e) AS rows_read, count(DISTINCT seq) AS rows_with, (SELECT count(*) FROM e) - count(DISTINCT seq) AS rows_without,
      count(*) AS candidates, count(DISTINCT domain) AS domains FROM mined""",
    **{name: _batch_sql(o, where) for name, (o, where) in BATCHES.items()},
}
