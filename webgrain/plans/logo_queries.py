"""Logo candidates of the pages' sites, scored and ranked.

Candidates come from a list of kinds of images, with the page's host, first title word and sizes in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.operators import logos
from webgrain.operators.logos import P

#: (source, address, alt, width, height); ~h is the host, ~b its first label, ~w the title's first word. Sizes below 0 are unknown.
KINDS = [
    ("header-image", "https://~h/assets/logo.svg", "~b logo", 180, 40), ("header-image", "https://~h/img/hero-bg.jpg", "Get started with ~w", 1200, 500), ("header-image", "https://~h/a/x.png", "", -1, -1),
    ("header-image", "https://~h/flags.svg", "EN", 24, 16), ("header-image", "https://~h/sessions/background.png", "~w", 300, 100), ("img-logo", "https://cdn.org/brand-assets/logo_full.png", "~b", 320, 90),
    ("img-logo", "https://~h/customers/acme-logo.jpeg", "A long view of a crosswalk showcasing the logo of a customer on a window display", 640, 480), ("img-logo", "https://~h/wordmark.webp?w=300", "~w wordmark", 300, 60),
    ("img-logo", "https://~h/images/x/product.png", "Google Play", 64, 64), ("img-logo", "https://~h/site-logo.png", "", 700, 430), ("og:image", "https://~h/share.jpg", "", 1200, 630), ("og:image", "https://~h/og/~b-logo.png", "~b logo", 400, 400),
    ("og:image", "https://scontent-lax.cdninstagram.com/v/t51.29/1.jpg", "", -1, -1), ("og:image", "https://~h/~b.png", "Structured data image", 200, 200), ("og:image", "https://~h/sitefailover/images/a.png", "logo", -1, -1),
    ("icon", "https://~h/favicon.ico", "default favicon", -1, -1), ("icon", "https://~h/favicon.svg", "", 32, 32), ("icon", "https://~h/~b-icon-32.png", "", 32, 32), ("icon", "https://~h/primary-logo.svg?v=2", "", 512, 512),
    ("apple-touch-icon", "https://~h/apple-touch-icon.png", "", 180, 180), ("apple-touch-icon", "https://~h/brandmark.png", "", 48, 48), ("icon", "https://~h/icons/app.svg", "", 120, 121),
    ("other", "https://~h/any.gif", "~w", 10, 10), ("img-logo", "https://pbs.twimg.com/media/logo.webp", "logo", 90, 30), ("img-logo", "https://~h/brand/mark.png", "~b", 128, 128), ("header-image", "https://~h/logo", "Home", 200, -1),
    ("header-image", "https://~h/x/annual-letter.png", "Annual letter of ~w and everything that was written in it", 90, 60), ("img-logo", "https://~h/docs/logo.png", "docs", 100, 100), ("og:image", "https://~h/identity.png", "~w ~b", 300, 100),
    ("icon", "https://~h/icon_1.webp", "", 64, 64),
]
_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_LABEL = "regexp_extract(regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www[.]', ''), '^([^.]*)', 1)"
_WORD = "regexp_extract(html, '<title>([^ <]*)', 1)"


def _rows() -> str:
    """One SELECT of the kinds as rows (k, source, address, alt, width, height), read alike by both engines."""
    return "(VALUES " + ", ".join(f"({k}, '{s}', '{u}', '{a}', {w}, {h})" for k, (s, u, a, w, h) in enumerate(KINDS)) + ") AS c(k, source, address, words, w, h)"


def _fill(x: str) -> str:
    return f"replace(replace(replace({x}, '~h', {_HOST}), '~b', {_LABEL}), '~w', {_WORD})"


_SELECT = f"""SELECT page_id AS site, k AS place, {_fill("address")} AS url, source, nullif({_fill("words")}, '') AS alt, nullif(w, -1) AS width, nullif(h, -1) AS height,
  url AS home, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages CROSS JOIN {_rows()} WHERE (page_id * 7 + k * 3) % 11 < 4"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with a part of the list of kinds, which is short and the same at every size."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows = spark.sql(_SELECT.replace("FROM pages", "FROM {pages}"), pages=pages)
    return rows.withColumn("tokens", logos.brand_tokens(F.col("home"), F.col("title"))).drop("home", "title")


def logo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logos.score_candidates(_candidates(spark, sf_dir)).select("site", "place", "logo_role", "score", "reason", "transparency")


def logo_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logos.rank_candidates(_candidates(spark, sf_dir)).select("site", "place", "rank", "score", "is_strong")


def logo_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logos.site_summary(logos.rank_candidates(_candidates(spark, sf_dir)))


def _m(text: str, name: str) -> str:
    return f"coalesce(regexp_matches({text}, '{P[name].replace(chr(39), chr(39) * 2)}', 'i'), false)"


def _any(texts: str, test: str) -> str:
    return f"len(list_filter(tokens, lambda t: {test})) > 0" if not texts else f"len(list_filter({texts}, lambda t: {test})) > 0"


def _named(text: str) -> str:
    return f"CASE WHEN length(t) < 2 THEN false WHEN length(t) <= 3 THEN regexp_matches({text}, '(^|[^a-z0-9_])' || t || '($|[^a-z0-9_])') ELSE contains({text}, t) END"


_STOP = ", ".join(f"'{w}'" for w in logos.TITLE_STOP_WORDS)
_ICON = "source IN ('icon', 'apple-touch-icon')"
_BOTH = "width IS NOT NULL AND height IS NOT NULL"
_SCORE_SQL = rf"""a AS (
  SELECT *, lower(regexp_extract(regexp_replace(regexp_extract(home, '^https?://([^/?#:]+)', 1), '^www[.]', '', 'i'), '^([^.]*)', 1)) AS label,
    list_filter(regexp_split_to_array(regexp_split_to_array(lower(trim(regexp_replace(title, '\s+', ' ', 'g'))), '\s*[|\-–—]\s*')[1], '[^a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) AS named
  FROM ({_SELECT})
), b AS (
  SELECT *, list_concat(CASE WHEN (length(label) >= 3 AND label NOT IN ({_STOP})) OR length(label) = 2 THEN [label] ELSE [] END, named) AS tokens,
    lower(regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1)) AS p, replace(lower(regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1)), '?', ' ?') AS pp, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host,
    coalesce(alt, '') AS raw, lower(trim(regexp_replace(coalesce(alt, ''), '\s+', ' ', 'g'))) AS an, lower(url || ' ' || coalesce(alt, '')) AS blob, width / height AS ratio, greatest(width, height) AS big FROM a
), f1 AS (
  SELECT *, {_m("p", "marketing_path")} AS m_path, {_m("p", "brand_assets")} AND {_m("p", "logoish")} AS assets, {_m("an", "logoish_alt")} AS l_alt,
    coalesce({_BOTH} AND ratio BETWEEN 0.82 AND 1.22, false) AS squareish, coalesce({_BOTH} AND ratio BETWEEN 0.88 AND 1.12, false) AS square,
    coalesce({_BOTH} AND width >= 72 AND height BETWEEN 20 AND 160 AND ratio BETWEEN 1.55 AND 6.5, false) AS wide, coalesce({_BOTH} AND width >= 72 AND height BETWEEN 20 AND 160 AND ratio BETWEEN 1.6 AND 6.5, false) AS wshape,
    regexp_matches(p, 'logo|brand|mark|identity|wordmark') AS logoish, {_m("p", "favicon_svg")} AS svg_mark, {_m("p", "failover")} AS failover, {_m("host", "social_host")} AS cdn, {_m("p", "social_path")} AS feed FROM b
), f2 AS (
  SELECT *, NOT m_path AND ({_m("p", "full_wordmark")} OR assets) AS whole, NOT m_path AND ({_m("p", "primary_logo")} OR assets OR {_m("p", "logoish")}) AS strong,
    an <> '' AND ({_m("an", "marketing_alt")} OR {_m("an", "photo_alt")} OR regexp_matches(an, '^switch to\b') OR (length(an) > 55 AND NOT l_alt) OR length(an) > 72) AS promo,
    trim(raw) <> '' AND ({_m("trim(raw)", "photo_alt_wide")} OR (length(an) > 72 AND {_m("an", "logo_word")})) AS caption,
    an <> '' AND l_alt AND NOT {_m("an", "photo_alt")} AND (length(an) <= 72 OR {_m("an", "logo_word")}) AS says,
    {_any("", f"length(t) >= 2 AND (an = t OR an = t || ' logo' OR an = t || ' wordmark' OR (length(an) <= length(t) + 12 AND {_named('an')} AND NOT {_m('an', 'marketing_alt')} AND len(string_split(an, ' ')) <= 4 AND string_split(an, ' ')[1] = t))")} AS titled,
    {_any("", _named("pp"))} AS tok_path, {_any("", _named("CASE WHEN raw <> '' THEN lower(raw) || ' ' || pp ELSE pp END"))} AS tok_any FROM f1
), f3 AS (
  SELECT *, CASE WHEN caption THEN tok_path ELSE tok_any END AS brand, titled OR says AS names,
    CASE WHEN {_ICON} AND NOT contains(host, 'scontent') AND NOT feed THEN false WHEN {_m("p", "icon_only")} OR {_m("p", "ico_folder")} OR NOT cdn THEN false
      ELSE feed OR (source IN ('og:image', 'header-image') AND NOT strong) OR ({_m("p", "random_raster")} AND NOT strong) END AS thumb FROM f2
), f4 AS (
  SELECT *, thumb OR m_path OR promo OR (source = 'img-logo' AND length(raw) > 72 AND {_m("raw", "logo_word")}) AS marketing,
    NOT whole AND ({_ICON} OR {_m("p", "icon_only")} OR svg_mark OR (coalesce({_BOTH} AND big <= 64, false) AND squareish) OR (squareish AND NOT wide AND strong AND coalesce(big >= 56, false))) AS iconish,
    CASE WHEN source = 'og:image' THEN NOT {_m("url", "plain_logo")} WHEN {_ICON} THEN NOT ({_m("url", "svg")} AND regexp_matches(url, 'logo|wordmark', 'i')) AND ({_m("url", "ico")} OR regexp_matches(url, 'favicon', 'i') OR source = 'icon') ELSE false END AS fav,
    {_m("blob", "product_hint")} OR {_m("blob", "product_alt")} OR {_m("url", "product_path")} OR (coalesce({_BOTH} AND ratio BETWEEN 0.86 AND 1.14 AND width BETWEEN 36 AND 200 AND height BETWEEN 36 AND 200, false) AND NOT {_ICON} AND {_m("url", "product_folder")}) AS product,
    {_m("blob", "marketing_blob")} OR (source = 'img-logo' AND caption) AS customer,
    {_m("blob", "flags")} OR {_m("blob", "nav_decor")} OR regexp_matches(trim(raw), '^[A-Z]{{2,3}}$') OR (source = 'header-image' AND {_m("blob", "decor_header")} AND NOT {_m("blob", "logoish")}) AS decor,
    coalesce(big, width, height) AS side FROM f3
), f5 AS (
  SELECT *, {_m("pp", "favicon_svg")} OR (NOT fav AND NOT {_m("pp", "ico")} AND ({_m("pp", "primary_mark")} OR ({_m("pp", "logoish")} AND NOT {_m("pp", "marketing_blob")}))) AS mark,
    NOT thumb AND NOT marketing AND NOT failover AND ((whole AND NOT promo AND NOT iconish) OR (strong AND NOT promo AND (source = 'img-logo' OR {_ICON} OR svg_mark OR (source IN ('header-image', 'og:image') AND (names OR wide)))) OR names) AS evidence,
    source = 'og:image' AND NOT thumb AND NOT promo AND (says OR strong OR titled) AS preview,
    source = 'og:image' AND (contains(lower(raw), 'logo') OR logoish OR brand OR coalesce({_BOTH} AND ratio BETWEEN 0.45 AND 2.2 AND width BETWEEN 40 AND 520 AND height BETWEEN 40 AND 520, false)) AS previews,
    coalesce(side <= 64, false) OR ({_ICON} AND {_m("url", "small_icon")}) AS tiny,
    coalesce({_BOTH} AND big >= 96 AND least(width, height) >= 28 AND NOT (square AND big <= 128) AND ratio BETWEEN 0.55 AND 4.5, false) AS large,
    {_any("", "length(t) >= 3 AND contains(p, t)")} AS in_path, regexp_extract(regexp_extract(p, '^([^?]*)', 1), '[.]([a-z0-9]+)$', 1) AS ext FROM f4
), r AS (
  SELECT *, NOT {_m("pp", "marketing_path")} AND ({_m("pp", "primary_logo")} OR {_m("pp", "logoish")}) AS strong_pp, ext = 'svg' OR {_m("url", "svg")} AS svg,
    CASE WHEN failover OR thumb THEN 'social_preview' WHEN marketing THEN 'marketing_image' WHEN source = 'og:image' AND NOT preview THEN 'social_preview' WHEN evidence OR (whole AND NOT promo AND NOT iconish) THEN 'wordmark'
      WHEN (preview AND NOT wide AND squareish AND NOT whole) OR svg_mark THEN 'icon_mark' WHEN {_ICON} AND (strong OR in_path) THEN CASE WHEN NOT {_m("p", "svg")} AND coalesce({_BOTH} AND big <= 48, false) THEN 'fallback_icon' ELSE 'icon_mark' END
      WHEN squareish AND strong AND NOT wide AND NOT whole AND iconish AND coalesce(big >= 56, false) THEN 'icon_mark' WHEN {_ICON} THEN 'fallback_icon' WHEN preview AND NOT whole THEN 'icon_mark' ELSE 'unknown' END AS role FROM f5
), held AS (
  SELECT *, [
    CASE source WHEN 'header-image' THEN CASE WHEN evidence THEN ['94', 'header/nav image'] ELSE ['36', 'header/nav image (weak logo evidence)'] END WHEN 'img-logo' THEN CASE WHEN brand THEN ['78', 'logo-tagged image (brand match)'] ELSE ['68', 'logo-tagged image'] END
      WHEN 'og:image' THEN CASE WHEN previews THEN ['32', 'og:image (logo-like)'] ELSE ['6', 'og:image (generic)'] END WHEN 'apple-touch-icon' THEN ['22', 'apple-touch-icon (fallback)'] WHEN 'icon' THEN ['8', 'favicon/icon (fallback)'] ELSE ['4', 'image'] END,
    CASE WHEN brand THEN ['42', 'brand name in alt/path'] END, CASE WHEN says AND NOT promo THEN ['18', 'alt matches logo keyword'] END, CASE WHEN regexp_matches(pp, 'primary[_-]?logo') THEN ['40', 'primary logo asset path'] END,
    CASE WHEN strong_pp THEN ['14', 'brand logo path'] WHEN logoish THEN ['6', 'logo-like path'] END,
    CASE WHEN svg THEN ['16', 'SVG wordmark/logo'] WHEN ext = 'png' THEN ['6', 'PNG'] WHEN ext = 'webp' THEN ['4', 'WebP'] WHEN ext IN ('jpg', 'jpeg') THEN ['-12', 'JPEG (often photo)'] END,
    CASE WHEN wshape AND evidence THEN ['18', 'wordmark proportions'] WHEN wshape THEN ['-8', 'not enough logo evidence'] END, CASE WHEN role = 'wordmark' AND evidence THEN ['20', 'classified wordmark'] END,
    CASE role WHEN 'marketing_image' THEN ['-150', 'penalized: marketing image'] WHEN 'social_preview' THEN ['-150', 'penalized: social preview'] END, CASE WHEN thumb THEN ['-180', 'social media thumbnail; not a logo asset'] END,
    CASE WHEN source = 'header-image' AND evidence THEN ['10', 'header wordmark with brand match'] END, CASE WHEN large AND (logoish OR brand) THEN ['12', 'larger logo-like graphic'] END,
    CASE WHEN side >= 120 AND NOT square THEN ['8', 'larger usable dimensions'] END, CASE WHEN mark THEN ['58', 'primary brand mark asset'] END, CASE WHEN {_m("pp", "favicon_svg")} THEN ['14', 'SVG favicon brand mark'] END,
    CASE WHEN {_m("pp", "ico")} THEN ['-30', 'favicon .ico (weak for print)'] END, CASE WHEN failover THEN ['-160', 'penalized: failover/HTML logo path'] END, CASE WHEN customer OR marketing THEN ['-120', 'penalized: marketing/customer image'] END,
    CASE WHEN decor THEN ['-85', 'penalized: nav/decor image'] END, CASE WHEN source = 'og:image' AND NOT logoish AND NOT {_m("raw", "logo_word")} THEN ['-45', 'penalized: generic og:image share art'] END,
    CASE WHEN product THEN ['-58', 'penalized: product/app icon'] END, CASE WHEN {_ICON} AND NOT mark THEN CASE WHEN role = 'icon_mark' THEN ['-10', 'compact icon mark'] ELSE ['-36', 'favicon fallback'] END END,
    CASE WHEN role = 'icon_mark' AND (brand OR mark) THEN ['22', 'brand icon mark'] END, CASE WHEN tiny AND NOT mark AND role <> 'icon_mark' THEN ['-48', 'small icon penalty'] END,
    CASE WHEN {_ICON} AND square AND NOT mark AND role = 'fallback_icon' THEN ['-28', 'square favicon/app icon'] END, CASE WHEN width > 640 THEN ['-16', 'very wide'] END, CASE WHEN height > 420 THEN ['-12', 'very tall'] END
  ] AS points FROM r
), scored AS MATERIALIZED (
  SELECT *, CAST(list_sum(list_transform(points, lambda x: CAST(x[1] AS INT))) AS INT) AS score, array_to_string(list_filter(list_transform(points, lambda x: x[2]), lambda x: x IS NOT NULL), '; ') AS reason,
    CASE WHEN svg THEN 'likely_transparent' WHEN ext IN ('jpg', 'jpeg') THEN 'likely_opaque' ELSE 'unknown' END AS transparency FROM held
)"""
_RANK_SQL = f"""bonus AS (SELECT * REPLACE (score + CASE transparency WHEN 'likely_transparent' THEN CASE WHEN {_ICON} AND tiny THEN 1 ELSE 3 END WHEN 'likely_opaque' THEN -3 ELSE 0 END AS score) FROM scored),
good AS (SELECT *, NOT (role IN ('marketing_image', 'social_preview') OR thumb OR product OR customer OR marketing OR decor) AND ((mark AND score >= 70) OR (role = 'icon_mark' AND score >= 68 AND (brand OR mark)) OR score >= 120 OR (source = 'header-image' AND evidence)
  OR (source = 'img-logo' AND evidence AND (wshape OR score >= 85)) OR (wshape AND evidence)) AS is_strong FROM bonus),
pool AS (SELECT *, bool_or(is_strong) OVER s AS has_strong, bool_or(is_strong AND (role = 'wordmark' OR (role = 'icon_mark' AND evidence))) OVER s AS has_word FROM (SELECT * FROM (SELECT *, bool_or(NOT thumb) OVER (PARTITION BY site) AS others FROM good) WHERE NOT (others AND thumb)) WINDOW s AS (PARTITION BY site)),
hidden AS (SELECT *, has_strong AND NOT is_strong AND (thumb OR product OR customer OR decor OR failover OR role IN ('social_preview', 'marketing_image') OR (has_word AND (role = 'fallback_icon' OR ({_ICON} AND role <> 'icon_mark' AND NOT mark)))
  OR (has_word AND source = 'og:image' AND role <> 'wordmark') OR ({_ICON} AND role <> 'icon_mark' AND (tiny OR score < 45)) OR (source = 'og:image' AND (NOT previews OR score < 55)) OR (source = 'apple-touch-icon' AND tiny) OR score < 20) AS hide FROM pool),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, place) AS rank FROM (SELECT *, bool_or(NOT hide) OVER (PARTITION BY site) AS some_left FROM hidden) WHERE NOT (some_left AND hide))"""

QUERIES = {"logo_scores": logo_scores, "logo_ranking": logo_ranking, "logo_sites": logo_sites}
SQL = {
    "logo_scores": f"WITH {_SCORE_SQL} SELECT site, place, role AS logo_role, score, reason, transparency FROM scored",
    "logo_ranking": f"WITH {_SCORE_SQL}, {_RANK_SQL} SELECT site, place, rank, score, is_strong FROM ranked WHERE rank <= 6",
    "logo_sites": f"""WITH {_SCORE_SQL}, {_RANK_SQL} SELECT site, count(*) AS n_shown, count(*) FILTER (is_strong) AS n_strong, arg_min(url, rank) AS best_url, arg_min(role, rank) AS best_role,
      bool_and(role IN ('fallback_icon', 'social_preview', 'unknown')) AS only_icons FROM ranked WHERE rank <= 6 GROUP BY site""",
}
