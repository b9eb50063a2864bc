"""Extraction records made from the pages, and the review rows that come out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.functions import href
from webgrain.operators import records
from webgrain.plans import inputs
from webgrain.plans.url_sql import href_sql, resolve_sql

# The text of a page's title and of its first links, as JSON writes them.
_ESC = "replace(replace({0}, chr(92), concat(chr(92), chr(92))), '\"', concat(chr(92), '\"'))"
_TITLE = _ESC.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")
_WORD = _ESC.format("regexp_extract(html, '<a href=\"/([^\"]*)\"', 1)")
_WORD2 = _ESC.format("regexp_extract(html, '<li><a href=\"/[^\"]*\">[^<]*</a></li><li><a href=\"/([^\"]*)\"', 1)")
_AD = _ESC.format("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")
_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_HEX = "concat('#', lpad(CAST(page_id * 7919 % 1000000 AS STRING), 6, '0'))"
_HEX2 = "concat('#', lpad(CAST(page_id * 104729 % 1000000 AS STRING), 6, '0'))"
_N4 = "lpad(CAST(page_id * 37 % 10000 AS STRING), 4, '0')"


def _json(template: str) -> str:
    """A concat() of a JSON text in which {{name}} stands for a value."""
    values = {"title": _TITLE, "word": _WORD, "word2": _WORD2, "ad": _AD, "host": _HOST, "url": "url", "hex": _HEX, "hex2": _HEX2, "n4": _N4, "id": "CAST(page_id AS STRING)", "pages": "CAST(page_id % 6 AS STRING)"}
    parts = []
    for k, piece in enumerate(" ".join(template.split()).split("~")):
        parts.append(values[piece] if k % 2 else "'" + piece.replace("'", "''") + "'")
    return f"concat({', '.join(parts)})"


_INPUT = '"input":{"ds_id":"~id~","ds_number":"DS-~id~","project_title":"~title~ booth","domain":"~host~","canonical_domain":"","normalized_url":"~url~","source_column":"website_url","first_req_description":"~ad~ ~title~","first_req_note":null},"elapsed_ms":~id~'
_SHAPES = [
    """{~input~,"status":"success","expo_output":{"business":{"name":" ~title~ ","website":"~url~","canonicalUrl":"HTTPS://~host~:443/a/../~word~"},
      "content":{"contact":{"email":"Info@~host~","phone":"+1 (555) 010-~n4~","address":"~word~ Street 12,  ~title~","social":["https://Instagram.com/~word~","x.com/~word2~","https://instagram.com/~word~"]},
        "services":["~word~ ~word2~","~WORD~"," "],"products":[{"name":"~word2~","price":"3"},{"title":" ","label":"no"},{"x":{"label":"~ad~"},"y":"extra"}]},
      "brand":{"colors":["~hex~","Primary ~hex2~"],"palette":{"navy":"~hex2~","logo":{"a":"#111111"},"url":"#222222","deep":[["#abc",{"Accent":"#~n4~00"}]]},"paletteSource":"Explicit","paletteRawColorCount":~pages~,
        "logoCandidates":[{"url":" https://~host~/logo.png ","source":"img","logoRole":"full"},{"url":"","source":"og"},{"url":"/x.svg"}]},
      "designIntake":{"recommendedHeadline":"~ad~","productCategory":" Booth "},"metadata":{"source":"scraper","pagesInspected":~pages~,"claude":{"model":"m-~id~"},"warnings":[]}}}""",
    """{~input~,"status":"success","expo_output":{"business":{"name":"~title~"},"emails":["A@~host~","a@~host~","bad mail address"],"phoneNumbers":[{"label":"main office line","number":"555 010 ~n4~"},{"number":"(555) 010-~n4~"}],
      "socialLinks":[{"platform":"Facebook","url":"https://facebook.com/../~word~ ~word2~"}],"links":{"blog":"~host~/b?q=~title~","mail":"mailto:x@y.z"},
      "Offerings":["~word~",{"items":["~word~","~word2~"]}],"extracted":{"services":"~ad~"},"palette":["~hex~"],"metadata":{"warnings":["Palette was derived from logo"],"pagesInspected":~pages~},
      "designIntake":{"recommendedHeadline":"~title~","recommendedSupportingText":" ~ad~ "}}}""",
    """{~input~,"status":"partial","expo_output":{"business":{"name":null,"offerings":{"a":["~word~"],"b":{"c":"~word2~"}}},"contact":{"offices":[{"location":{"street":"~word~ avenue ~n4~","lines":[["Floor 2, ~title~",null,7,true],[]],"tel":"~n4~ 555 01"}},{"location":{"city":"~word~"}}]},
      "designSpec":{"brandColors":{"teal":"~hex~","Secondary":"none","bg":"~word~"},"palette_source":"logo-fallback","palette_confidence":"HIGH"},"content":{"products":["~word~","~word2~","~title~","~ad~","fifth"]}}}""",
    """{~input~,"status":"fetch_error","error_message":"HTTP 403 for ~url~","expo_output":null}""",
    """{~input~,"status":"success","expo_output":{"content":""",
]
RECORD = "CASE page_id % 5 " + " ".join(f"WHEN {k} THEN {_json(s.replace('~input~', _INPUT).replace('~WORD~', '~word~'))}" for k, s in enumerate(_SHAPES)) + " END"


def extraction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, record): a JSON record for each page; every fifth is cut off."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", f"{RECORD} AS record")


def records_to_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.review_rows(extraction_records(spark, sf_dir))


def records_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.bad_records(extraction_records(spark, sf_dir)).select("page_id", F.length("record").cast("long").alias("chars"))


_LINK = "concat(CASE page_id % 4 WHEN 0 THEN '../' WHEN 1 THEN '/a/./b/../' WHEN 2 THEN '?q=' ELSE '//Other.Example.ORG:443/x/%2e%2E/' END, regexp_extract(html, '<title>([^<]*)</title>', 1))"
_ADDRESS = "concat(CASE page_id % 3 WHEN 0 THEN 'HTTPS://User@' WHEN 1 THEN ' http:' || chr(92) || chr(92) ELSE '' END, " + _HOST + ", CASE page_id % 2 WHEN 0 THEN ':080' ELSE '' END, '/x/../', regexp_extract(html, '<title>([^<]*)</title>', 1), '#', regexp_extract(html, '<title>([^<]*)</title>', 1))"


def url_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "url", f"{_LINK} AS link", f"{_ADDRESS} AS address")
    return pages.select("page_id", href.safe(F.col("address")).alias("href"), href.resolve(F.col("link"), F.col("url")).alias("resolved"))


# SQL of the walks, over json_tree: way holds the keys of a leaf with . between, list steps as [].
_BLANK = r"[\s\x{00a0}\x{feff}]+"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}|{_BLANK}$', '', 'g')"


def _squeeze(x: str) -> str:
    return _trim(f"regexp_replace({x}, '{_BLANK}', ' ', 'g')")


_DIGITS = r"regexp_replace({0}, '\D', '', 'g')"
_HEX_CODE = r"""CASE WHEN regexp_matches({0}, '#([0-9A-Fa-f]{{3,8}})($|[^0-9A-Za-z_])') THEN '#' || CASE WHEN length(regexp_extract({0}, '#([0-9A-Fa-f]{{3,8}})($|[^0-9A-Za-z_])', 1)) = 3
    THEN lower(regexp_replace(regexp_extract({0}, '#([0-9A-Fa-f]{{3,8}})($|[^0-9A-Za-z_])', 1), '(.)', '\1\1', 'g')) ELSE lower(regexp_extract({0}, '#([0-9A-Fa-f]{{3,8}})($|[^0-9A-Za-z_])', 1)) END END"""


def _under(roots: list[tuple[str, ...]]) -> str:
    return "(VALUES " + ", ".join(f"({k}, '{'.'.join(r)}')" for k, r in enumerate(roots)) + ") r(root_nr, root)"


def _at(*keys: str) -> str:
    return f"(SELECT any_value(t) FROM leaf l WHERE l.page_id = b.page_id AND l.type = 'VARCHAR' AND l.way = '{'.'.join(keys)}')"


def _number(*keys: str) -> str:
    return f"(SELECT any_value(t) FROM leaf l WHERE l.page_id = b.page_id AND l.type <> 'VARCHAR' AND l.way = '{'.'.join(keys)}')"


def _owned(keys: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif({_trim(_at(*o, k))}, '')" for o in records.PALETTE_OWNERS for k in keys) + ")"


def _q(items: str, order: str, shown: str) -> str:
    """A JSON list of strings as text."""
    return f"'[' || string_agg(CAST(to_json({shown}) AS VARCHAR), ',' ORDER BY {order}) {items} || ']'"


def _hint(a: str, b: str) -> str:
    """How much of the larger set of words two texts share."""
    words = "list_distinct([w FOR w IN regexp_split_to_array(lower({0}), '[^a-z0-9]+') IF length(w) > 2])"
    x, y = words.format(a), words.format(b)
    share = f"len(list_intersect({x}, {y})) / greatest(len({x}), len({y}))"
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN '' WHEN {share} >= 0.5 THEN 'high' WHEN {share} >= 0.2 THEN 'partial' ELSE 'low' END"


_KEYED = [(o, k) for o in records.OFFERING_ROOTS for k in (("products", "services", "offerings") if o == ("business",) else ("products", "services"))]
_OFFER_ROOTS = [(*o, k) for o, k in _KEYED]

RECORDS_SQL = rf"""
WITH p AS (SELECT page_id, {RECORD} AS record FROM pages),
b AS MATERIALIZED (SELECT page_id, CAST(record AS JSON) AS j FROM p WHERE json_valid(record)),
node AS MATERIALIZED (
  SELECT b.page_id, e.id, e.parent, e.type, e.key, CASE WHEN e.type = 'VARCHAR' THEN e.atom ->> '$' ELSE CAST(e.atom AS VARCHAR) END AS t,
    regexp_replace(regexp_replace(e.fullkey, '\[[0-9]+\]', '.[]', 'g'), '^\$\.?', '') AS way
  FROM b, json_tree(b.j -> '$.expo_output') e
), names AS (
  SELECT o.page_id, o.id AS object_id, first(n.id ORDER BY CASE n.key WHEN 'name' THEN 1 WHEN 'title' THEN 2 ELSE 3 END) AS name_id, first(n.t ORDER BY CASE n.key WHEN 'name' THEN 1 WHEN 'title' THEN 2 ELSE 3 END) AS name
  FROM node o JOIN node n ON n.page_id = o.page_id AND n.parent = o.id AND n.type = 'VARCHAR' AND n.key IN ('name', 'title', 'label') WHERE o.type = 'OBJECT' GROUP BY ALL
), leaf AS MATERIALIZED (SELECT * FROM node WHERE t IS NOT NULL),
text_leaf AS MATERIALIZED (SELECT * FROM leaf WHERE type = 'VARCHAR'),
contact_t AS (
  SELECT page_id, root_nr, id, {_trim("t")} AS t,
    list_filter(string_split(way[length(root) + 2:], '.'), lambda k: k NOT IN ('[]', ''))[-1] AS hint
  FROM text_leaf JOIN {_under(records.CONTACT_ROOTS)} ON way = root OR starts_with(way, root || '.')
), contact_u AS MATERIALIZED (SELECT *, {href_sql("t", safe=True)} AS u FROM contact_t),
contact_k AS (
  SELECT page_id, root_nr, id, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN 'email'
      WHEN regexp_matches(t, '^(?i)[\d\s().+\-xext]+$') AND length({_DIGITS.format("t")}) >= 7 THEN 'phone'
      WHEN u IS NOT NULL THEN CASE WHEN regexp_matches(lower(u), 'instagram|facebook|fb\.com|linkedin|twitter|x\.com|youtube|youtu\.be|tiktok') THEN 'social' ELSE 'link' END
      WHEN length(t) > 8 THEN 'address' END AS kind, t, u, hint FROM contact_u
), contact_v AS (
  SELECT page_id, root_nr, id, kind, CASE kind WHEN 'email' THEN lower(t) WHEN 'phone' THEN t WHEN 'address' THEN {_squeeze("t")} ELSE u END AS v,
    CASE kind WHEN 'link' THEN nullif({_trim("hint")}, '') WHEN 'social' THEN CASE WHEN contains(lower(u), 'instagram') THEN 'Instagram' WHEN regexp_matches(lower(u), 'facebook|fb\.com') THEN 'Facebook' WHEN contains(lower(u), 'linkedin') THEN 'LinkedIn' WHEN regexp_matches(lower(u), 'twitter|x\.com') THEN 'X' WHEN regexp_matches(lower(u), 'youtube|youtu\.be') THEN 'YouTube' ELSE 'TikTok' END END AS label
  FROM contact_k WHERE kind IS NOT NULL
  UNION ALL
  SELECT page_id, 100 + root_nr, id, 'link', u, 'Website' FROM (SELECT page_id, root_nr, id, {href_sql("t", safe=True)} AS u FROM text_leaf JOIN {_under(records.WEBSITES)} ON way = root) WHERE u IS NOT NULL
), contact_d AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY root_nr, id) AS nr FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, kind, CASE kind WHEN 'phone' THEN {_DIGITS.format("v")} WHEN 'address' THEN lower(v) ELSE v END ORDER BY root_nr, id) AS seen FROM contact_v
  ) WHERE seen = 1
), contact AS MATERIALIZED (
  SELECT page_id, {_q("FILTER (kind = 'email' AND nr <= 8)", "nr", "v")} AS emails, {_q("FILTER (kind = 'phone' AND nr <= 8)", "nr", "v")} AS phones, {_q("FILTER (kind = 'address' AND nr <= 4)", "nr", "v")} AS addresses,
    '[' || string_agg('{{"label":' || CAST(to_json(label) AS VARCHAR) || ',"url":' || CAST(to_json(v) AS VARCHAR) || '}}', ',' ORDER BY nr) FILTER (kind = 'social' AND nr <= 12) || ']' AS social,
    '[' || string_agg('{{' || coalesce('"label":' || CAST(to_json(label) AS VARCHAR) || ',', '') || '"url":' || CAST(to_json(v) AS VARCHAR) || '}}', ',' ORDER BY nr) FILTER (kind = 'link' AND nr <= 8) || ']' AS links
  FROM contact_d GROUP BY page_id
), offer_r AS (
  SELECT * FROM {_under(_OFFER_ROOTS)}
  UNION ALL SELECT DISTINCT 2, way FROM node WHERE parent = 0 AND NOT contains(way, '.') AND regexp_matches(way, '{records.OFFERING_KEY}')
), offer_p AS (
  SELECT page_id, CASE WHEN root_nr = 2 AND NOT contains(root, '.') THEN 1.5 ELSE root_nr END AS root_nr, root, id, t, way,
    CASE WHEN contains(lower(string_split(root, '.')[-1]), 'product') AND NOT contains(lower(string_split(root, '.')[-1]), 'service') THEN 'products' WHEN contains(lower(string_split(root, '.')[-1]), 'service') THEN 'services' ELSE 'combined' END AS list
  FROM text_leaf JOIN offer_r ON way = root OR starts_with(way, root || '.')
), above AS (
  WITH RECURSIVE up AS (SELECT page_id, id AS leaf_id, id, parent FROM text_leaf UNION ALL SELECT up.page_id, leaf_id, n.id, n.parent FROM up JOIN node n ON n.page_id = up.page_id AND n.id = up.parent) SELECT * FROM up
), offer_h AS (
  SELECT DISTINCT o.page_id, o.root, o.id FROM offer_p o JOIN above a ON a.page_id = o.page_id AND a.leaf_id = o.id JOIN node n ON n.page_id = a.page_id AND n.id = a.parent AND (n.way = o.root OR starts_with(n.way, o.root || '.'))
  JOIN names ON names.page_id = a.page_id AND names.object_id = a.parent WHERE {_trim("names.name")} <> '' AND names.name_id <> a.id
), offer_v AS (
  SELECT page_id, root_nr, id, list, {_squeeze("t")}[1:160] AS v FROM offer_p ANTI JOIN offer_h USING (page_id, root, id)
), offer_all AS (
  SELECT page_id, list, v, 0 AS turn, root_nr, id FROM offer_v WHERE v <> '' UNION ALL SELECT page_id, 'every', v, CASE list WHEN 'combined' THEN 1 WHEN 'products' THEN 2 ELSE 3 END, root_nr, id FROM offer_v WHERE v <> ''
), offer_d AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, list ORDER BY turn, root_nr, id) AS nr FROM (SELECT *, row_number() OVER (PARTITION BY page_id, list, lower(v) ORDER BY turn, root_nr, id) AS seen FROM offer_all) WHERE seen = 1
), offer AS MATERIALIZED (
  SELECT page_id, {_q("FILTER (list = 'products' AND nr <= 24)", "nr", "v")} AS products, {_q("FILTER (list = 'services' AND nr <= 24)", "nr", "v")} AS services, {_q("FILTER (list = 'every' AND nr <= 32)", "nr", "v")} AS every FROM offer_d GROUP BY page_id
), color_t AS (
  SELECT page_id, root_nr, id, {_trim("CASE WHEN length(way) > length(root) AND NOT ends_with(way, '[]') AND regexp_matches(string_split(way, '.')[-1], '" + records.COLOR_LABEL + "') THEN string_split(way, '.')[-1] || ' ' || t ELSE t END")} AS t
  FROM text_leaf JOIN {_under(records.COLOR_ROOTS)} ON way = root OR starts_with(way, root || '.')
  WHERE NOT list_bool_or(list_transform(string_split(way[length(root) + 2:], '.'), lambda k: lower(k) = 'url' OR contains(lower(k), 'logo')))
), color_d AS (
  SELECT *, {_HEX_CODE.format("t")} AS hex FROM (SELECT *, row_number() OVER (PARTITION BY page_id, lower(t) ORDER BY root_nr, id) AS seen FROM color_t WHERE t <> '') WHERE seen = 1
), color_n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY root_nr, id) AS nr, min(CASE WHEN contains(lower(t), 'primary') THEN id END) OVER (PARTITION BY page_id) AS primary_id FROM color_d WHERE hex IS NOT NULL),
color AS MATERIALIZED (
  SELECT page_id, list(hex ORDER BY nr) FILTER (fresh) AS hexes, first(hex ORDER BY nr) FILTER (id = primary_id) AS first_hex, first(hex ORDER BY nr) FILTER (regexp_matches(lower(t), 'secondary|accent|teal|navy') AND id IS DISTINCT FROM primary_id) AS second_hex
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id, hex ORDER BY nr) = 1 AS fresh FROM color_n) GROUP BY page_id
), known AS (
  SELECT page_id, string_agg(root, ',' ORDER BY root_nr) AS paths FROM (
    SELECT DISTINCT page_id, root_nr, root FROM text_leaf JOIN {_under([tuple(c.split(".")) for c in records.COLOR_PATHS])} ON way = root OR starts_with(way, root || '.')
    WHERE {_trim("t")} <> '' AND NOT list_bool_or(list_transform(string_split(way[length(root) + 2:], '.'), lambda k: lower(k) = 'url' OR contains(lower(k), 'logo')))
  ) GROUP BY page_id
), m AS MATERIALIZED (
  SELECT page_id, j, {_owned(records.SOURCE_KEYS)} AS given, {_owned(records.CONFIDENCE_KEYS)} AS sure,
    EXISTS (SELECT 1 FROM text_leaf l WHERE l.page_id = b.page_id AND l.way = 'metadata.warnings.[]' AND regexp_matches(l.t, 'derived from logo|logo image \(palette fallback\)', 'i')) AS warned,
    {_trim("coalesce(" + _at("business", "name") + ", '')")} AS name, {_trim("coalesce(" + _at("designIntake", "recommendedHeadline") + ", '')")} AS headline,
    {_trim("coalesce(" + _at("designIntake", "productCategory") + ", '')")} AS category, {_trim("coalesce(" + _at("designIntake", "recommendedSupportingText") + ", '')")} AS supporting,
    {_trim("coalesce(" + _at("metadata", "source") + ", '')")} AS provider, {_trim("coalesce(" + _at("metadata", "claude", "model") + ", '')")} AS model,
    coalesce({_number("metadata", "pagesInspected")}, '') AS inspected, {_number("brand", "paletteRawColorCount")} AS raw_count,
    (SELECT list(l.t ORDER BY l.way DESC, l.id) FROM text_leaf l WHERE l.page_id = b.page_id AND l.way IN ('content.services.[]', 'content.products.[]') AND l.t <> '') AS listed,
    j -> '$.expo_output.brand.logoCandidates' AS logos
  FROM b
), x AS (
  SELECT m.*, contact.* EXCLUDE (page_id), offer.* EXCLUDE (page_id), paths, hexes, coalesce(first_hex, hexes[1], '') AS first_hex, coalesce(second_hex, hexes[2], '') AS second_hex,
    CASE WHEN lower(given) IN ('logo', 'logo_fallback', 'logo-fallback') THEN 'logo' WHEN lower(given) IN ('extraction', 'explicit', 'extracted', 'explicit_extraction') THEN 'extraction' ELSE given END AS source,
    {_trim("coalesce(j ->> '$.input.project_title', '')")} AS project, len(CAST(logos AS JSON[])) AS n_logos,
    list_filter(list_transform(CAST(logos AS JSON[])[1:5], lambda l: {{'url': {_trim("coalesce(l ->> '$.url', '')")}, 'rest': CASE WHEN l ->> '$.source' IS NULL THEN '' ELSE ',"source":' || CAST(l -> '$.source' AS VARCHAR) END || CASE WHEN l ->> '$.logoRole' IS NULL THEN '' ELSE ',"logoRole":' || CAST(l -> '$.logoRole' AS VARCHAR) END}}), lambda l: l.url <> '') AS kept_logos
  FROM m LEFT JOIN contact USING (page_id) LEFT JOIN offer USING (page_id) LEFT JOIN color USING (page_id) LEFT JOIN known USING (page_id)
), y AS (SELECT *, source IS NULL AND len(hexes) > 0 AS implied, warned OR coalesce(source = 'logo', false) AS from_logo FROM x),
z AS (SELECT *, CASE WHEN implied THEN CASE WHEN from_logo THEN 'logo' ELSE 'extraction' END ELSE coalesce(source, '') END AS palette_source FROM y)
SELECT page_id, {", ".join(f"coalesce(j ->> '$.input.{c}', '') AS {c}" for c in ("ds_number", "ds_id", "project_type", "shop_code", "normalized_url", "domain", "source_column"))}, project AS project_title,
  regexp_replace(lower(j ->> '$.input.domain'), '^www[.]', '') AS canonical_domain,
  CASE WHEN length(d) <= 240 THEN d ELSE d[1:239] || '…' END AS first_req_description_excerpt, '' AS first_req_note_excerpt,
  j ->> '$.status' AS status, j ->> '$.elapsed_ms' AS elapsed_ms, coalesce(j ->> '$.error_message', '') AS error_message,
  name AS extracted_business_name, category AS extracted_business_category, CASE WHEN headline <> '' AND lower(headline) <> lower(name) THEN headline ELSE '' END AS extracted_tagline,
  CASE WHEN supporting <> '' THEN supporting ELSE coalesce(array_to_string(listed[1:4], '; '), '') END AS extracted_summary,
  coalesce(emails, '') AS extracted_emails, coalesce(phones, '') AS extracted_phone_numbers, coalesce(social, '') AS extracted_social_links, coalesce(addresses, '') AS extracted_addresses, coalesce(links, '') AS extracted_contact_links,
  coalesce(products, '') AS extracted_products, coalesce(services, '') AS extracted_services, coalesce(every, '') AS extracted_products_services,
  CASE WHEN n_logos > 0 THEN CAST(n_logos AS VARCHAR) ELSE '' END AS logo_candidate_count, coalesce(kept_logos[1].url, '') AS selected_logo_url,
  CASE WHEN len(kept_logos) > 0 THEN '[' || array_to_string(list_transform(kept_logos, lambda l: '{{"url":' || CAST(to_json(l.url) AS VARCHAR) || l.rest || '}}'), ',') || ']' ELSE '' END AS logo_candidate_urls,
  CASE WHEN len(hexes) > 0 THEN CAST(to_json(hexes[1:4]) AS VARCHAR) ELSE '' END AS extracted_color_hexes, CASE WHEN palette_source = 'logo' AND len(hexes) > 0 THEN hexes[1] ELSE first_hex END AS primary_color_hex, CASE WHEN palette_source = 'logo' AND len(hexes) > 0 THEN coalesce(hexes[2], '') ELSE second_hex END AS secondary_color_hex, palette_source,
  coalesce(lower(sure), CASE WHEN implied THEN CASE WHEN from_logo THEN 'medium' ELSE 'unknown' END END, '') AS palette_confidence,
  CASE WHEN CAST(coalesce(raw_count, CASE WHEN palette_source = 'logo' AND len(hexes) > 0 THEN CAST(len(hexes) AS VARCHAR) END) AS BIGINT) > 0 THEN coalesce(raw_count, CAST(len(hexes) AS VARCHAR)) ELSE '' END AS palette_raw_color_count,
  CASE WHEN palette_source = 'logo' AND len(hexes) > 0 THEN CAST(len(hexes) AS VARCHAR) ELSE '' END AS palette_distinct_color_count,
  inspected AS pages_inspected, provider AS extraction_provider, model AS extraction_model,
  {_hint("project", "name")} AS business_name_similarity_hint,
  CASE WHEN project = '' OR name = '' THEN '' WHEN contains(lower(project), lower(name)) OR contains(lower(name), lower(project)) THEN 'high' ELSE {_hint("project", "name")} END AS title_business_name_overlap_hint,
  CASE WHEN coalesce(len(hexes), 0) = 0 THEN 'no_colors' WHEN from_logo THEN 'logo_fallback' ELSE 'explicit_extraction' END AS palette_category, coalesce(paths, '') AS color_paths
FROM (SELECT *, {_squeeze("coalesce(j ->> '$.input.first_req_description', '')")} AS d FROM z)
"""

QUERIES = {"records_to_reviews": records_to_reviews, "records_rejected": records_rejected, "url_href": url_href}

SQL = {
    "records_to_reviews": RECORDS_SQL,
    "records_rejected": f"SELECT page_id, length(record) AS chars FROM (SELECT page_id, {RECORD} AS record FROM pages) WHERE NOT json_valid(record)",
    "url_href": f"SELECT page_id, {href_sql('address', safe=True)} AS href, {resolve_sql('link', 'url')} AS resolved FROM (SELECT page_id, url, {_LINK} AS link, {_ADDRESS} AS address FROM pages)",
}
