"""Ranking of logo candidates: facts about each, a role by ordered rules, points by a table of rules with their reasons.

A candidate is a row (site, place, url, source, alt, width, height, tokens). Facts are
columns, worked out once in two passes; the role and every rule are conditions
on them. What to show is decided for a site as a whole: weak candidates go only
where a strong one stands beside them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions.base import trim

# Words, patterns and bounds of the rules. Patterns hold whatever the case.
TITLE_STOP_WORDS = ["home", "official", "site", "website", "welcome", "the", "and", "for", "inc", "llc", "ltd", "corp", "co"]
P = {
    "logoish": "logo|brand|mark|identity|wordmark|primary[_-]?logo",
    "logoish_alt": r"\blogo\b|wordmark",
    "primary_logo": "primary[_-]?logo|logo[_-]primary[_-]?logo|(?:^|/)[^/]*[_-]logo[_-]|site[_-]?logo|brand[_-]?mark|wordmark|full[_-]?logo|horizontal[_-]?logo",
    "full_wordmark": "primary[_-]?logo|logo[_-]primary[_-]?logo|wordmark|full[_-]?logo|horizontal[_-]?logo",
    "brand_assets": "brand[_-]?assets",
    "icon_only": r"favicon|apple[_-]?touch(?:[_-]?icon)?|app[_-]?icon|icon[_-]?\d|/icons?(?:/|$)|/32x32|/64x64",
    "ico_folder": "/images/ico/",
    "marketing_path": r"enterprise-accordion|nav-bg|testimonial|hero-?bg|case-study|customer-story|sessions-\d",
    "marketing_blob": r"enterprise-accordion|nav-bg|nav_background|sessions-\d|testimonial|headshot|case-study|customer-story|hero-?bg|bento|platform-graphic|annual-letter|the-happenings|lovable\.png|runway\.png|supabase\.png",
    "marketing_alt": r"\b(get started|switch to|world'?s best|learn more|try free|sign up|free trial|background|hero\b|hero image|sessions\b|testimonial|accordion|customer story|case study|bento|platform graphic|annual letter|overhead view|delivery bag|boutique|kiosk|newspaper)\b",
    "photo_alt": r"\b(view of|overhead|aerial|exterior|street view|imitating|forms a|crosswalk|showcasing)\b",
    "photo_alt_wide": r"\b(view of|overhead|aerial|exterior|street view|imitating|forms a|crosswalk|showcasing|delivery bag|boutique|kiosk|window display|door stoop|newspaper)\b",
    "failover": "sitefailover|sitedown|botfailover|failover.*/images/",
    "social_host": r"(?:^|\.)cdninstagram\.com$|(?:^|\.)fbcdn\.net$|(?:^|\.)twimg\.com$|^scontent[-.]|scontent-",
    "social_path": r"/(?:media|photos?|videos?|stories|reels?|p/|t51\.|t52\.|e15/|e35/)",
    "random_raster": r"\.(?:webp|jpe?g)(?:$|\?)",
    "primary_mark": r"(?:^|/)(?:favicon\.svg|logo(?:[_-]|\.|$)|wordmark|brand[_-]?mark|site[_-]?logo|stripe[_-]?logo)",
    "favicon_svg": r"favicon\.svg(?:$|\?)",
    "svg": r"\.svg(?:$|\?)",
    "ico": r"\.ico(?:$|\?)",
    "flags": r"flags\.svg|/flags(?:/|$)",
    "nav_decor": r"nav-bg|nav_background|sessions-\d",
    "decor_header": "background|sessions",
    "small_icon": r"fav[_-]?icon|favicon|icon[_-]?\d|/32x32|/64x64|width=32\b|height=32\b|width=64\b|height=64\b",
    "product_hint": r"\b(chrome|chromium|docs?|documents|sheets|slides|maps|youtube|gmail|android|workspace|playstore|play-store|app-store|drive|calendar|meet|photos|news|wallet|pay|assistant|gemini|earth|translate|classroom|keep|podcasts|wear|fit|chat|hangouts|duo|voice|contacts|lens|arts|books|games|pixel|nest|fi\b|tv\b|one\b|account|myaccount|product|app-icon|appicon|sprite|favicon-\d)\b",
    "product_alt": r"\b(google play|play store|app store|chrome|chromium|google docs|google sheets|google slides|google maps|youtube|gmail|android|gemini|drive|calendar|photos|wallet|assistant)\b",
    "product_path": r"/(chrome|docs|sheets|slides|maps|youtube|gmail|android|workspace|drive|calendar|meet|photos|news|play|store|apps?|products?|images/branding/product|intl/[a-z]{2}/about/products)/",
    "product_folder": "/(images|static|assets)/.*/(icon|logo_|product)",
    "plain_logo": "logo|brand|wordmark",
    "logo_word": r"\blogo\b",
}
ICONS = ["icon", "apple-touch-icon"]
SHOWN, STRONG_SCORE, MARK_SCORE, ICON_SCORE, TAGGED_SCORE = 6, 120, 70, 68, 85
WEAK_ICON, WEAK_PREVIEW, WEAK_ANY = 45, 55, 20


def host_token(url: Column) -> Column:
    """The first label of a host, if it says something."""
    label = F.regexp_extract(F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i)https?://([^/?#:]+)", 1)), r"^www\.", ""), r"^([^.]*)", 1)
    return F.when(((F.length(label) >= 3) & ~label.isin(*TITLE_STOP_WORDS)) | (F.length(label) == 2), label)


def brand_tokens(url: Column, *titles: Column) -> Column:
    """Distinct words that stand for a site: its host's first label, then the words of its titles' first parts."""
    words = []
    for title in titles:
        t = F.lower(trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " ")))
        first = F.get(F.split(t, r"\s*[|\-–—]\s*"), F.lit(0))
        words.append(F.filter(F.split(first, "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*TITLE_STOP_WORDS)))
    return F.array_distinct(F.concat(F.array_compact(F.array(host_token(url))), *words))


def _has(text: Column, name: str) -> Column:
    return F.coalesce(text.rlike(f"(?i)(?:{P[name]})"), F.lit(False))


def _names(text: Column, token: Column) -> Column:
    """Whether a text holds a brand's word; a short one only as a word of its own."""
    word = F.rlike(text, F.concat(F.lit(r"(?<![a-z0-9_])"), token, F.lit("(?![a-z0-9_])")))
    return F.when(F.length(token) < 2, False).when(F.length(token) <= 3, word).otherwise(F.contains(text, token))


def _facts(rows: DataFrame) -> DataFrame:
    c, tokens = F.col, F.col("tokens")
    path = F.lower(F.regexp_extract("url", r"^(?i)https?://[^/?#]*([^#]*)", 1))
    split = F.lower(F.regexp_replace(F.regexp_extract("url", r"^(?i)https?://[^/?#]*([^#]*)", 1), r"\?", " ?"))
    alt = F.coalesce("alt", F.lit(""))
    base = rows.withColumns({
        "_path": path, "_parts": split, "_host": F.lower(F.regexp_extract("url", r"^(?i)https?://([^/?#:]+)", 1)), "_alt": F.lower(alt),
        "_alt_n": F.lower(trim(F.regexp_replace(alt, r"\s+", " "))), "_blob": F.lower(F.concat("url", F.lit(" "), alt)), "_trimmed": trim(alt),
        "_icon": c("source").isin(*ICONS), "_ratio": F.col("width") / F.col("height"), "_max": F.greatest("width", "height"), "_both": c("width").isNotNull() & c("height").isNotNull(),
    })
    marketing_path = _has(c("_path"), "marketing_path")
    assets = _has(c("_path"), "brand_assets") & _has(c("_path"), "logoish")
    ratio = lambda low, high: F.coalesce(c("_both") & c("_ratio").between(low, high), F.lit(False))
    wide = lambda low: F.coalesce(c("_both") & (c("width") >= 72) & c("height").between(20, 160) & c("_ratio").between(low, 6.5), F.lit(False))
    short_name = lambda t: (F.length("_alt_n") <= F.length(t) + 12) & _names(c("_alt_n"), t) & ~_has(c("_alt_n"), "marketing_alt") & (F.size(F.split("_alt_n", " ")) <= 4) & (F.get(F.split("_alt_n", " "), F.lit(0)) == t)
    names_alt = F.exists(tokens, lambda t: (F.length(t) >= 2) & ((c("_alt_n") == t) | (c("_alt_n") == F.concat(t, F.lit(" logo"))) | (c("_alt_n") == F.concat(t, F.lit(" wordmark"))) | short_name(t)))
    logoish_alt = _has(c("_alt_n"), "logoish_alt")
    copy = _has(c("_alt_n"), "marketing_alt") | _has(c("_alt_n"), "photo_alt") | c("_alt_n").rlike(r"^switch to\b") | ((F.length("_alt_n") > 55) & ~logoish_alt) | (F.length("_alt_n") > 72)
    caption = _has(c("_trimmed"), "photo_alt_wide") | ((F.length("_alt_n") > 72) & _has(c("_alt_n"), "logo_word"))
    in_path = F.exists(tokens, lambda t: _names(c("_parts"), t))
    social = _has(c("_host"), "social_host")
    strong_path = ~marketing_path & (_has(c("_path"), "full_wordmark") | _has(c("_path"), "primary_logo") | assets | _has(c("_path"), "logoish"))
    feed = _has(c("_path"), "social_path")
    thumbnail = (
        F.when(c("_icon") & ~c("_host").contains("scontent") & ~feed, False)
        .when(_has(c("_path"), "icon_only") | _has(c("_path"), "ico_folder") | ~social, False)
        .otherwise(feed | (c("source").isin("og:image", "header-image") & ~strong_path) | (_has(c("_path"), "random_raster") & ~strong_path))
    )
    first = base.withColumns({
        "_full": ~marketing_path & (_has(c("_path"), "full_wordmark") | assets), "_strong": strong_path, "_marketing_path": marketing_path,
        "_copy": (c("_alt_n") != "") & copy, "_caption": (c("_trimmed") != "") & caption, "_says_logo": (c("_alt_n") != "") & logoish_alt & ~_has(c("_alt_n"), "photo_alt") & ((F.length("_alt_n") <= 72) | _has(c("_alt_n"), "logo_word")),
        "_named": names_alt, "_brand": F.when(caption & (c("_trimmed") != ""), in_path).otherwise(in_path | F.exists(tokens, lambda t: _names(F.concat_ws(" ", F.when(c("_alt") != "", c("_alt")), c("_parts")), t))),
        "_thumb": thumbnail, "_failover": _has(c("_path"), "failover"), "_svg_mark": _has(c("_path"), "favicon_svg"),
        "_squareish": ratio(0.82, 1.22), "_square": ratio(0.88, 1.12), "_wide": wide(1.55), "_wordmark_shape": wide(1.6),
        "_logoish_url": F.coalesce(F.col("_path").rlike("logo|brand|mark|identity|wordmark"), F.lit(False)),
        "_small_square": ratio(0.45, 2.2) & F.coalesce(c("width").between(40, 520) & c("height").between(40, 520), F.lit(False)),
    })
    favicon = F.when(c("source") == "og:image", ~_has(c("url"), "plain_logo")).when(
        c("_icon"), ~(_has(c("url"), "svg") & F.coalesce(c("url").rlike("(?i)logo|wordmark"), F.lit(False))) & (_has(c("url"), "ico") | F.coalesce(c("url").rlike("(?i)favicon"), F.lit(False)) | (c("source") == "icon"))
    ).otherwise(False)
    icon_like = ~c("_full") & (c("_icon") | _has(c("_path"), "icon_only") | c("_svg_mark") | (F.coalesce(c("_both") & (c("_max") <= 64), F.lit(False)) & c("_squareish")) | (c("_squareish") & ~c("_wide") & c("_strong") & F.coalesce(c("_max") >= 56, F.lit(False))))
    marketing = c("_thumb") | c("_marketing_path") | c("_copy") | ((c("source") == "img-logo") & (F.length(F.coalesce("alt", F.lit(""))) > 72) & _has(c("alt"), "logo_word"))
    product = _has(c("_blob"), "product_hint") | _has(c("_blob"), "product_alt") | _has(c("url"), "product_path")
    folder = ratio(0.86, 1.14) & F.coalesce(c("width").between(36, 200) & c("height").between(36, 200), F.lit(False)) & ~c("_icon") & _has(c("url"), "product_folder")
    second = first.withColumns({
        "_icon_like": icon_like, "_marketing": marketing, "_favicon": favicon, "_product": product | folder,
        "_customer": _has(c("_blob"), "marketing_blob") | ((c("source") == "img-logo") & c("_caption")),
        "_decor": _has(c("_blob"), "flags") | _has(c("_blob"), "nav_decor") | c("_trimmed").rlike("^[A-Z]{2,3}$") | ((c("source") == "header-image") & _has(c("_blob"), "decor_header") & ~_has(c("_blob"), "logoish")),
        "_side": F.coalesce("_max", "width", "height"),
    })
    mark = _has(c("_parts"), "favicon_svg") | (~c("_favicon") & ~_has(c("_parts"), "ico") & (_has(c("_parts"), "primary_mark") | (_has(c("_parts"), "logoish") & ~_has(c("_parts"), "marketing_blob"))))
    named = c("_named") | c("_says_logo")
    evidence = (c("_full") & ~c("_copy") & ~c("_icon_like")) | (c("_strong") & ~c("_copy") & (c("source").isin("img-logo", *ICONS) | c("_svg_mark") | (c("source").isin("header-image", "og:image") & (named | c("_wide"))))) | named
    preview = (c("source") == "og:image") & ~c("_thumb") & ~c("_copy") & (c("_says_logo") | c("_strong") | c("_named"))
    preview_wide = (c("source") == "og:image") & (F.contains("_alt", F.lit("logo")) | c("_logoish_url") | c("_brand") | c("_small_square"))
    return second.withColumns({
        "_mark": mark, "_evidence": ~c("_thumb") & ~c("_marketing") & ~c("_failover") & evidence, "_preview": preview, "_preview_wide": preview_wide,
        "_tiny": F.coalesce(c("_side") <= 64, F.lit(False)) | (c("_icon") & _has(c("url"), "small_icon")),
        "_large": F.coalesce(c("_both") & (c("_max") >= 96) & (F.least("width", "height") >= 28) & ~(c("_square") & (c("_max") <= 128)) & c("_ratio").between(0.55, 4.5), F.lit(False)),
        "_token_in_path": F.exists(tokens, lambda t: (F.length(t) >= 3) & F.contains(c("_path"), t)),
        "_kind": F.regexp_extract(F.regexp_extract("_path", r"^([^?]*)", 1), r"\.([a-z0-9]+)$", 1),
    })


def role() -> Column:
    """wordmark, icon_mark, social_preview, marketing_image, fallback_icon or unknown, by the first rule that holds."""
    c = F.col
    linked_mark = c("_icon") & (c("_strong") | c("_token_in_path"))
    rules = [
        (c("_failover") | c("_thumb"), "social_preview"),
        (c("_marketing"), "marketing_image"),
        ((c("source") == "og:image") & ~c("_preview"), "social_preview"),
        (c("_evidence") | (c("_full") & ~c("_copy") & ~c("_icon_like")), "wordmark"),
        ((c("_preview") & ~c("_wide") & c("_squareish") & ~c("_full")) | c("_svg_mark"), "icon_mark"),
        (linked_mark & _has(c("_path"), "svg"), "icon_mark"),
        (linked_mark & F.coalesce(c("_both") & (c("_max") <= 48), F.lit(False)), "fallback_icon"),
        (linked_mark, "icon_mark"),
        (c("_squareish") & c("_strong") & ~c("_wide") & ~c("_full") & c("_icon_like") & F.coalesce(c("_max") >= 56, F.lit(False)), "icon_mark"),
        (c("_icon"), "fallback_icon"),
        (c("_preview") & ~c("_full"), "icon_mark"),
    ]
    return reduce(lambda so_far, rule: so_far.when(rule[0], rule[1]), rules[1:], F.when(*rules[0])).otherwise("unknown")


def _rules() -> list[tuple[Column, int, list[str]]]:
    """(condition, points, reasons), in the order of the reasons. The points and reasons."""
    c, is_role = F.col, lambda name: F.col("logo_role") == name
    source, kind = lambda name: F.col("source") == name, F.col("_kind")
    known = c("source").isin("header-image", "img-logo", "og:image", *ICONS)
    svg = (kind == "svg") | _has(c("url"), "svg")
    return [
        (source("header-image") & c("_evidence"), 94, ["header/nav image"]),
        (source("header-image") & ~c("_evidence"), 36, ["header/nav image (weak logo evidence)"]),
        (source("img-logo") & c("_brand"), 78, ["logo-tagged image (brand match)"]),
        (source("img-logo") & ~c("_brand"), 68, ["logo-tagged image"]),
        (source("og:image") & c("_preview_wide"), 32, ["og:image (logo-like)"]),
        (source("og:image") & ~c("_preview_wide"), 6, ["og:image (generic)"]),
        (source("apple-touch-icon"), 22, ["apple-touch-icon (fallback)"]),
        (source("icon"), 8, ["favicon/icon (fallback)"]),
        (~known, 4, ["image"]),
        (c("_brand"), 42, ["brand name in alt/path"]),
        (c("_says_logo") & ~c("_copy"), 18, ["alt matches logo keyword"]),
        (c("_parts").rlike("primary[_-]?logo"), 40, ["primary logo asset path"]),
        (c("_strong_parts"), 14, ["brand logo path"]),
        (~c("_strong_parts") & c("_logoish_url"), 6, ["logo-like path"]),
        (svg, 16, ["SVG wordmark/logo"]),
        (~svg & (kind == "png"), 6, ["PNG"]),
        (~svg & (kind == "webp"), 4, ["WebP"]),
        (~svg & kind.isin("jpg", "jpeg"), -12, ["JPEG (often photo)"]),
        (c("_wordmark_shape") & c("_evidence"), 18, ["wordmark proportions"]),
        (c("_wordmark_shape") & ~c("_evidence"), -8, ["not enough logo evidence"]),
        (is_role("wordmark") & c("_evidence"), 20, ["classified wordmark"]),
        (is_role("marketing_image"), -150, ["penalized: marketing image"]),
        (is_role("social_preview"), -150, ["penalized: social preview"]),
        (c("_thumb"), -180, ["social media thumbnail", "not a logo asset"]),
        (source("header-image") & c("_evidence"), 10, ["header wordmark with brand match"]),
        (c("_large") & (c("_logoish_url") | c("_brand")), 12, ["larger logo-like graphic"]),
        (F.coalesce(c("_side") >= 120, F.lit(False)) & ~c("_square"), 8, ["larger usable dimensions"]),
        (c("_mark"), 58, ["primary brand mark asset"]),
        (_has(c("_parts"), "favicon_svg"), 14, ["SVG favicon brand mark"]),
        (_has(c("_parts"), "ico"), -30, ["favicon .ico (weak for print)"]),
        (c("_failover"), -160, ["penalized: failover/HTML logo path"]),
        (c("_customer") | c("_marketing"), -120, ["penalized: marketing/customer image"]),
        (c("_decor"), -85, ["penalized: nav/decor image"]),
        (source("og:image") & ~c("_logoish_url") & ~_has(c("_alt"), "logo_word"), -45, ["penalized: generic og:image share art"]),
        (c("_product"), -58, ["penalized: product/app icon"]),
        (c("_icon") & ~c("_mark") & is_role("icon_mark"), -10, ["compact icon mark"]),
        (c("_icon") & ~c("_mark") & ~is_role("icon_mark"), -36, ["favicon fallback"]),
        (is_role("icon_mark") & (c("_brand") | c("_mark")), 22, ["brand icon mark"]),
        (c("_tiny") & ~c("_mark") & ~is_role("icon_mark"), -48, ["small icon penalty"]),
        (c("_icon") & c("_square") & ~c("_mark") & is_role("fallback_icon"), -28, ["square favicon/app icon"]),
        (F.coalesce(c("width") > 640, F.lit(False)), -16, ["very wide"]),
        (F.coalesce(c("height") > 420, F.lit(False)), -12, ["very tall"]),
    ]


def _scored(rows: DataFrame) -> DataFrame:
    """rows with their facts, logo_role, score, reason and transparency."""
    known = _facts(rows).withColumn("logo_role", role())
    parts = F.col("_parts")
    known = known.withColumn("_strong_parts", ~_has(parts, "marketing_path") & (_has(parts, "primary_logo") | _has(parts, "logoish")))
    held = F.array(*(F.when(holds, F.struct(F.lit(points).alias("points"), F.array(*map(F.lit, reasons)).alias("reasons"))) for holds, points, reasons in _rules()))
    known = known.withColumn("_held", F.array_compact(held))
    svg = _has(F.col("url"), "svg") | (F.col("_kind") == "svg")
    return known.withColumns({
        "score": F.aggregate("_held", F.lit(0), lambda total, x: total + x["points"]),
        "reason": F.array_join(F.flatten(F.transform("_held", lambda x: x["reasons"])), "; "),
        "transparency": F.when(svg, "likely_transparent").when(F.col("_kind").isin("jpg", "jpeg"), "likely_opaque").otherwise("unknown"),
    })


def _with_bonus(scored: DataFrame) -> DataFrame:
    """A few points for transparency, fewer for tiny icons."""
    tiny, clear = F.col("_icon") & F.col("_tiny"), F.col("transparency") == "likely_transparent"
    points = F.when(clear & tiny, 1).when(clear, 3).when(F.col("transparency") == "likely_opaque", -3).otherwise(0)
    words = F.when(clear & tiny, "transparent favicon (minor bonus)").when(clear & _has(F.col("url"), "svg"), "likely transparent SVG").when(clear, "likely transparent")
    return scored.withColumns({"score": F.col("score") + points, "reason": F.concat_ws("; ", F.when(F.col("reason") != "", F.col("reason")), words)})


def is_strong() -> Column:
    """Whether a scored candidate is good enough to be shown first."""
    c = F.col
    refused = c("logo_role").isin("marketing_image", "social_preview") | c("_thumb") | c("_product") | c("_customer") | c("_marketing") | c("_decor")
    good = [
        c("_mark") & (c("score") >= MARK_SCORE),
        (c("logo_role") == "icon_mark") & (c("score") >= ICON_SCORE) & (c("_brand") | c("_mark")),
        c("score") >= STRONG_SCORE,
        (c("source") == "header-image") & c("_evidence"),
        (c("source") == "img-logo") & c("_evidence") & (c("_wordmark_shape") | (c("score") >= TAGGED_SCORE)),
        c("_wordmark_shape") & c("_evidence"),
    ]
    return ~refused & reduce(lambda a, b: a | b, good)


def is_weak(has_wordmark: Column) -> Column:
    """Whether a candidate is to go where a strong one stands beside it; has_wordmark: one of the strong ones is a wordmark."""
    c = F.col
    icon, preview = c("_icon") & (c("logo_role") != "icon_mark"), c("source") == "og:image"
    bad = [
        c("_thumb") | c("_product") | c("_customer") | c("_decor") | c("_failover"),
        c("logo_role").isin("social_preview", "marketing_image"),
        has_wordmark & ((c("logo_role") == "fallback_icon") | (icon & ~c("_mark"))),
        has_wordmark & preview & (c("logo_role") != "wordmark"),
        icon & (c("_tiny") | (c("score") < WEAK_ICON)),
        preview & (~c("_preview_wide") | (c("score") < WEAK_PREVIEW)),
        (c("source") == "apple-touch-icon") & c("_tiny"),
        c("score") < WEAK_ANY,
    ]
    return ~c("_strong_design") & reduce(lambda a, b: a | b, bad)


SCORED = ["logo_role", "score", "reason", "transparency"]


def score_candidates(rows: DataFrame) -> DataFrame:
    """rows (url, source, alt, width, height, tokens and others) with logo_role, score, reason and transparency.

    A null alt is no text; null sizes are unknown; an address that is none has an empty path.
    """
    return _scored(rows).select(*(c for c in rows.columns if c not in SCORED), *SCORED)


def rank_candidates(rows: DataFrame, most: int = SHOWN) -> DataFrame:
    """The candidates of each site to show, best first: rank from 1, with the columns of score_candidates and is_strong.

    Social thumbnails go where anything else is there, weak candidates where a strong one
    is there (unless nothing would be left), then all beyond the first few. Ties keep the order
    of place. A site's candidates are few (a page's list is capped where it is made).
    """
    scored = _with_bonus(_scored(rows)).withColumn("_strong_design", is_strong())
    site = Window.partitionBy("site")
    other = F.max((~F.col("_thumb")).cast("int")).over(site) == 1
    pool = scored.withColumn("_other", other).filter(~F.col("_other") | ~F.col("_thumb"))
    wordmark = F.col("_strong_design") & ((F.col("logo_role") == "wordmark") | ((F.col("logo_role") == "icon_mark") & F.col("_evidence")))
    pool = pool.withColumns({"_any": F.max(F.col("_strong_design").cast("int")).over(site) == 1, "_word": F.max(wordmark.cast("int")).over(site) == 1})
    pool = pool.withColumn("_hide", F.col("_any") & is_weak(F.col("_word")))
    left = F.max((~F.col("_hide")).cast("int")).over(site) == 1
    shown = pool.withColumn("_left", left).filter(~F.col("_left") | ~F.col("_hide"))
    ranked = shown.withColumn("rank", F.row_number().over(site.orderBy(F.desc("score"), "place")).cast("long")).filter(F.col("rank") <= most)
    return ranked.select(*(c for c in rows.columns if c not in SCORED), *SCORED, F.col("_strong_design").alias("is_strong"), "rank")


def site_summary(ranked: DataFrame) -> DataFrame:
    """(site, n_shown, n_strong, best_url, best_role, only_icons): what a site's ranked candidates amount to."""
    weak = F.col("logo_role").isin("fallback_icon", "social_preview", "unknown")
    return ranked.groupBy("site").agg(
        F.count("*").alias("n_shown"),
        F.count_if("is_strong").alias("n_strong"),
        F.min_by("url", "rank").alias("best_url"),
        F.min_by("logo_role", "rank").alias("best_role"),
        (F.count_if(weak) == F.count("*")).alias("only_icons"),
    )
