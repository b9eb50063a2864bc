"""Queries on texts, contacts, colours and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.functions import color, contact, text
from webgrain.operators import pages
from webgrain.plans.url_sql import resolve_sql

_HEX = "concat('#', lpad(lower(hex(doc_id * 7919 % 16777216)), 6, '0'))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", contact.emails_in_text(F.col("text")).alias("emails"))
    return found.filter(F.size("emails") > 0).select("doc_id", F.array_join(F.array_sort("emails"), ",").alias("emails"))


def contact_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.format_string("%s%09d", F.when(F.col("doc_id") % 2 == 0, "1-").otherwise(""), F.col("doc_id") * 7919 % 1000000000)
    cell = F.concat(number, F.lit("0; tel:+44 20 "), F.col("doc_id").cast("string"), F.lit("| x"))
    return _docs(spark, sf_dir).select("doc_id", contact.phone_field(cell).alias("phones"), contact.email_field(F.concat(F.lit("MAILTO:A"), "doc_id", F.lit("@Ex.org?x, a b, c@d"))).alias("emails"))


def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


def token_overlap_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    a, b = turns.select("conv_id", "turn", F.col("text").alias("x")), turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", text.overlap_hint(F.col("x"), F.col("y")).alias("hint"))


def color_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _docs(spark, sf_dir).select("doc_id", F.expr(_HEX).alias("hex")).withColumn("lab", color.lab(F.col("hex")))
    return h.select(
        "doc_id",
        *(F.round(f"lab.{c}", 6).alias(c) for c in "lab"),
        F.round(color.contrast_ratio(F.col("hex"), F.lit("#ffffff")), 6).alias("contrast"),
        F.coalesce(color.neutral_kind(F.col("hex")), F.lit("")).alias("neutral"),
    )


def palette_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    shades = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("doc_id") * 7919 + i * i * 66053) % 16777216)), 6, "0")))
    return _docs(spark, sf_dir).select("doc_id", color.refine_palette(shades).alias("p")).select("doc_id", F.array_join("p.colors", ",").alias("colors"), "p.raw_count", "p.distinct_count")


def page_links_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.site_links(_pages(spark, sf_dir)).select("page_id", "url", "score", "page_type", F.col("rank").cast("long").alias("rank"))


def page_extra_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.pick_extra_pages(pages.site_links(_pages(spark, sf_dir))).select("page_id", "url", F.col("pick").cast("long").alias("pick"))


def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.page_features(_pages(spark, sf_dir))
    return found.select("page_id", "title", "heading", "footer", F.col("n_links").cast("long").alias("n_links"), F.length("text").cast("long").alias("text_chars"))


_TRIM = r"regexp_replace({0}, '^[\s ]+|[\s ]+$', '', 'g')"
_TOKENS = "list_distinct([t for t in regexp_split_to_array(lower({0}), '[^a-z0-9]+') if length(t) > 2])"
_LIN = "CASE WHEN {0} / 255.0 > 0.04045 THEN pow(({0} / 255.0 + 0.055) / 1.055, 2.4) ELSE {0} / 255.0 / 12.92 END"
_F = "CASE WHEN {0} > 0.008856 THEN pow({0}, 1 / 3.0) ELSE 7.787 * {0} + 16 / 116.0 END"


def _plain(x: str) -> str:
    bare = rf"regexp_replace({x}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<svg\b.*?</svg>|<!--.*?-->|<[^>]*>', ' ', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = f"replace({bare}, '{name}', '{char}')"
    return _TRIM.format(rf"regexp_replace({bare}, '[\s ]+', ' ', 'g')")


_BARE = r"(SELECT page_id, url, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g') AS html FROM pages)"
_WORDS = ["about", "contact", "service", "product", "portfolio", "work", "team", "story", "menu", "shop", "location"]
_LINKS = rf"""h AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=["'']([^"'']*)["'']', 1) AS hs FROM {_BARE}),
  e AS (SELECT page_id, url AS base, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS nr FROM h),
  a AS (SELECT page_id, base, nr, url FROM (SELECT page_id, base, nr, {resolve_sql("h", "base")} AS url FROM e) WHERE url IS NOT NULL),
  k AS (SELECT *, regexp_replace(lower(regexp_replace(url, '#.*$', '')), '/+$', '') AS key, regexp_replace(lower(regexp_replace(base, '#.*$', '')), '/+$', '') AS home FROM a
    WHERE regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www[.]', '') = regexp_replace(lower(regexp_extract(base, '^https?://([^/?#:]*)', 1)), '^www[.]', '')),
  f AS (SELECT *, row_number() OVER (PARTITION BY page_id, key ORDER BY nr) AS first FROM k WHERE key <> home AND NOT regexp_matches(url, '(?i)[.](pdf|zip|jpe?g|png|gif|webp|svg|ico|css|js|mp[34]|docx?|xlsx?)([?#]|$)')),
  p AS (SELECT page_id, url, nr, lower(regexp_extract(url, '^(?i)https?://[^/?#]+([^?#]*)', 1)) AS path, lower(regexp_extract(url, '^(?i)https?://[^/?#]+([^#]*)', 1)) AS rest FROM f WHERE first = 1),
  s AS (SELECT page_id, url, nr, {" + ".join(f"CASE WHEN contains(rest, '{w}') THEN 12 ELSE 0 END" for w in _WORDS)}
      - CASE WHEN regexp_matches(rest, 'privacy|terms|cookie|legal|gdpr|login|sign[-_]?in|sign[-_]?up|cart|checkout|account/|wp-admin') THEN 25 ELSE 0 END AS score,
    CASE WHEN regexp_matches(path, 'about|our-story|company|who-we|team\b') THEN 'about' WHEN regexp_matches(path, 'contact|locations?|offices?|get-in-touch|reach-us') THEN 'contact'
      WHEN regexp_matches(path, 'portfolio|our-work|^/work|case-stud') THEN 'portfolio' WHEN regexp_matches(path, 'service|product|solution|offering|menu|shop|store|catalog') THEN 'services' ELSE 'other' END AS page_type FROM p),
  l AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, nr) AS rank FROM s)"""

QUERIES = {
    "contact_extract": contact_extract,
    "contact_normalize": contact_normalize,
    "excerpt": excerpt,
    "token_overlap_hint": token_overlap_hint,
    "color_lab": color_lab,
    "palette_refine": palette_refine,
    "page_links_ranked": page_links_ranked,
    "page_extra_pick": page_extra_pick,
    "page_features": page_features,
}

SQL = {
    "contact_extract": r"""SELECT doc_id, array_to_string(list_sort(list_distinct(es)), ',') AS emails FROM (
      SELECT doc_id, [lower(e) for e in regexp_extract_all(text, '(?i)\b[a-z0-9._%+-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+\b')] AS es FROM documents
    ) WHERE len(es) > 0""",
    "contact_normalize": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '+1 ' ELSE '' END || '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10]
        || CASE WHEN length(doc_id::VARCHAR) >= 3 THEN ', +44 20 ' || doc_id ELSE '' END AS phones, 'a' || doc_id || '@ex.org' AS emails
      FROM (SELECT doc_id, lpad(CAST(doc_id * 7919 % 1000000000 AS VARCHAR), 9, '0') || '0' AS d FROM documents)""",
    "excerpt": f"SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE t[1:239] || '…' END AS excerpt FROM (SELECT doc_id, {_TRIM.format(r'''regexp_replace(text, '[\s ]+', ' ', 'g')''')} AS t FROM documents)",
    "token_overlap_hint": f"""SELECT conv_id, turn, CASE WHEN len(x) = 0 OR len(y) = 0 THEN '' WHEN o >= 0.5 THEN 'high' WHEN o >= 0.2 THEN 'partial' ELSE 'low' END AS hint FROM (
      SELECT *, len(list_intersect(x, y)) / greatest(len(x), len(y)) AS o FROM (SELECT a.conv_id, a.turn, {_TOKENS.format("a.text")} AS x, {_TOKENS.format("b.text")} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1))""",
    "color_lab": f"""WITH c AS (SELECT doc_id, (doc_id * 7919 % 16777216) // 65536 AS r, (doc_id * 7919 % 16777216) // 256 % 256 AS g, doc_id * 7919 % 256 AS b FROM documents),
      l AS (SELECT *, {_LIN.format("r")} AS lr, {_LIN.format("g")} AS lg, {_LIN.format("b")} AS lb, greatest(r, g, b) / 255.0 AS hi, least(r, g, b) / 255.0 AS lo FROM c),
      x AS (SELECT *, (lr * 0.4124 + lg * 0.3576 + lb * 0.1805) / 0.95047 AS x, lr * 0.2126 + lg * 0.7152 + lb * 0.0722 AS y, (lr * 0.0193 + lg * 0.1192 + lb * 0.9505) / 1.08883 AS z, (hi + lo) / 2 AS light FROM l),
      f AS (SELECT *, {_F.format("x")} AS fx, {_F.format("y")} AS fy, {_F.format("z")} AS fz, CASE WHEN hi = lo THEN 0.0 WHEN light > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS sat FROM x)
      SELECT doc_id, round(116 * fy - 16, 6) AS l, round(500 * (fx - fy), 6) AS a, round(200 * (fy - fz), 6) AS b, round(1.05 / (y + 0.05), 6) AS contrast,
        CASE WHEN light < 0.08 THEN 'dark' WHEN light > 0.92 AND sat < 0.12 THEN 'light' WHEN sat < 0.15 AND light > 0.12 AND light < 0.88 THEN 'gray' ELSE '' END AS neutral FROM f""",
    "page_links_ranked": f"WITH {_LINKS} SELECT page_id, url, score, page_type, rank FROM l",
    "page_extra_pick": f"""WITH {_LINKS}, t AS (SELECT *, CASE WHEN page_type = 'about' THEN 1 WHEN page_type = 'services' THEN 2 WHEN page_type IN ('contact', 'portfolio') THEN 3 WHEN score > 0 THEN 4 ELSE 5 END AS turn FROM l),
      q AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY turn, rank) AS pick FROM t) SELECT page_id, url, pick FROM q WHERE pick <= 3""",
    "page_features": rf"""WITH h AS (SELECT page_id, {_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {_plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading,
        {_plain("regexp_extract(html, '(?is)<footer[^>]*>(.*?)</footer>', 1)")} AS footer, len(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=["'']')) AS n_links, length({_plain("html")}) AS text_chars FROM {_BARE})
      SELECT page_id, title, heading, CASE WHEN length(footer) >= 20 THEN footer[1:2000] ELSE '' END AS footer, n_links, text_chars FROM h""",
}
