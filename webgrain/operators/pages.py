"""Features of HTML pages, by native expressions on the markup.

Regular expressions reach what these features need (titles, headings, links,
footers, fonts); they build no document tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions import contact, href
from webgrain.functions import url as U
from webgrain.functions.base import distinct_capped, distinct_ignoring_case, trim

ASSET = r"(?i)\.(pdf|zip|jpe?g|png|gif|webp|svg|ico|css|js|mp[34]|docx?|xlsx?)([?#]|$)"


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(group))


def _first(html: Column, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1)


def plain_text(html: Column) -> Column:
    """Text without tags, scripts and styles, common entities decoded, white space squeezed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|svg)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return trim(F.regexp_replace(bare, r"[\s ]+", " "))


def without_scripts(html: Column) -> Column:
    """Markup without scripts, styles and comments, whose text is no part of the page."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")


def title(html: Column) -> Column:
    return plain_text(_first(html, r"(?is)<title[^>]*>(.*?)</title>"))


def heading(html: Column) -> Column:
    return plain_text(_first(html, r"(?is)<h1[^>]*>(.*?)</h1>"))


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by name or property, '' if there is none."""
    tag = _first(html, rf"""(?is)(<meta\b[^>]*\b(?:name|property)=["']{name}["'][^>]*>)""")
    return plain_text(_first(tag, r"""(?is)\bcontent=["']([^"']*)["']"""))


def footer_text(html: Column, most: int = 2000) -> Column:
    """Texts of footer elements of 20 characters or more, joined."""
    texts = F.filter(F.transform(_all(html, r"(?is)<footer\b[^>]*>(.*?)</footer>"), plain_text), lambda t: F.length(t) >= 20)
    return F.substring(F.array_join(texts, "\n"), 1, most)


def hrefs(html: Column) -> Column:
    return _all(html, r"""(?is)<a\b[^>]*\bhref=["']([^"']*)["']""")


def mail_links(html: Column) -> Column:
    return contact.distinct_emails(F.filter(hrefs(html), lambda h: h.rlike("^(?i)mailto:")))


def phone_links(html: Column) -> Column:
    return contact.distinct_phones(F.filter(hrefs(html), lambda h: h.rlike("^(?i)tel:")))


def font_families(html: Column) -> Column:
    """Families of font-family declarations and of Google font links, distinct, without keywords."""
    name = r"""(?:"[^"<>]*"|'[^'<>]*'|[^;}"',]+)"""
    css = F.flatten(F.transform(_all(html, rf"(?i)font-family\s*:\s*({name}(?:\s*,\s*{name})*)"), lambda f: F.split(f, ",")))
    google = F.transform(_all(html, r"(?i)fonts\.googleapis\.com/css2?\?family=([^:&\"']+)"), lambda f: F.replace(f, F.lit("+"), F.lit(" ")))
    names = F.transform(F.concat(google, css), lambda f: trim(F.regexp_replace(f, "[\"']", "")))
    keep = F.filter(names, lambda f: (f != "") & ~f.rlike(r"^(?i)(inherit|initial|unset|serif|sans-serif|monospace|cursive|system-ui|var\(.*|[\d.]+(px|em|rem|%)?)$"))
    return F.slice(distinct_ignoring_case(keep), 1, 14)


# Families that hint at a style.
SERIF = "playfair|georgia|garamond|merriweather|lora|times|baskerville|caslon|dm serif|libre baskerville|noto serif|source serif"
SANS = "inter|helvetica|arial|roboto|open sans|lato|segoe|sf pro|system|neue|frutiger|avenir|futura|gill sans|source sans|noto sans|ibm plex sans|work sans"
GEOMETRIC = "montserrat|poppins|nunito|raleway|quicksand|rubik|outfit|manrope|urbanist"
PLAYFUL = "comic|pacifico|lobster|fredoka|baloo|chewy|bubblegum|marker|handwriting|caveat|amatic"
TECHNICAL = "mono|courier|consolas|menlo|fira code|jetbrains|source code|ibm plex mono|roboto mono|inconsolata|space mono"


def style_guess(families: Column) -> Column:
    """playful, technical, classic_serif (serif hints and no others), modern_sans or unknown, from font families."""
    names = F.lower(F.array_join(families, " "))
    hints = lambda words: names.rlike(rf"\b({words})\b")
    plain = hints(SANS) | hints(GEOMETRIC)
    return (
        F.when(trim(names) == "", "unknown")
        .when(hints(PLAYFUL), "playful")
        .when(hints(TECHNICAL), "technical")
        .when(hints(SERIF) & ~plain, "classic_serif")
        .when(plain, "modern_sans")
        .otherwise("unknown")
    )


def absolute(link: Column, base: Column) -> Column:
    """An http(s) address from a link and its page's address, as the URL standard resolves it; null for other schemes."""
    return href.resolve(link, base)


def site_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Links of each page to other pages of its host, distinct: page, url, at, score, page_type, rank.

    rank orders a page's links by falling score, then place. Links are numbered
    inside their page's row, so nothing but short rows is shuffled.
    """
    home = U.page_key(F.col(url_col))
    links = F.transform(hrefs(without_scripts(F.col(html_col))), lambda h, i: F.struct(absolute(h, F.col(url_col)).alias("url"), i.alias("at")))
    each = pages.select(F.col(id_col), F.col(url_col).alias("_base"), home.alias("_home"), F.explode(links).alias("l"))
    each = each.select(id_col, "_base", "_home", F.col("l.url").alias("url"), F.col("l.at").alias("at"), U.page_key(F.col("l.url")).alias("key"))
    kept = each.filter(U.same_host(F.col("url"), F.col("_base")) & ~F.col("url").rlike(ASSET) & (F.col("key") != F.col("_home")))
    first = kept.groupBy(id_col, "key").agg(F.min("at").alias("at"), F.min_by("url", "at").alias("url"))
    path = F.regexp_extract("url", r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    rest = F.regexp_extract("url", r"^(?i)https?://[^/?#]+([^#]*)", 1)
    scored = first.select(id_col, "url", "at", U.link_score(rest).alias("score"), U.page_type(path).alias("page_type"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "at")))


def pick_extra_pages(links: DataFrame, id_col: str = "page_id", most: int = 3) -> DataFrame:
    """Of each page up to three links, by rank: all about, then all services, contact or portfolio, positive scores, the rest."""
    kind = F.col("page_type")
    turn = (
        F.when(kind == "about", 1)
        .when(kind == "services", 2)
        .when(kind.isin("contact", "portfolio"), 3)
        .when(F.col("score") > 0, 4)
        .otherwise(5)
    )
    picked = links.withColumn("turn", turn).withColumn("pick", F.row_number().over(Window.partitionBy(id_col).orderBy("turn", "rank")))
    return picked.filter(F.col("pick") <= most)


def page_features(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page with its features in place of the markup; a null page has empty ones."""
    h = without_scripts(F.col(html_col))
    new = {
        "title": title(h), "heading": heading(h), "description": meta(h, "description"), "og_title": meta(h, "og:title"),
        "footer": footer_text(h), "emails": distinct_capped(mail_links(h), 16), "phones": distinct_capped(phone_links(h), 16),
        "fonts": font_families(F.col(html_col)), "n_links": F.size(hrefs(h)), "text": plain_text(h),
        "page_type": U.page_type(F.regexp_extract(url_col, r"^(?i)https?://[^/?#]+([^?#]*)", 1)),
    }
    return pages.select(*(c for c in pages.columns if c not in (*new, html_col)), *(v.alias(k) for k, v in new.items()))


def within_budget(pages: DataFrame, site_col: str, seq_col: str, text_col: str = "text", budget: int = 18_000, first: int = 8_000, later: int = 4_000) -> DataFrame:
    """Texts cut to a site's running budget: so much for its first page, less for each later one."""
    order = Window.partitionBy(site_col).orderBy(seq_col)
    own = F.least(F.length(text_col), F.when(F.row_number().over(order) == 1, first).otherwise(later))
    sized = pages.withColumn("_own", own)
    before = F.coalesce(F.sum("_own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col("_own"), budget - F.col("_before"))).cast("int")
    return sized.withColumn("_before", before).withColumn(text_col, F.substring(F.col(text_col), F.lit(1), left)).drop("_own", "_before")


LEVELS = ["low", "medium", "high"]
# Where good logo candidates come from, and the roles of weak ones.
STRONG_LOGO_SOURCES, WEAK_LOGO_ROLES = ["header-image", "img-logo", "og:image"], ["fallback_icon", "social_preview", "unknown"]
FETCHED = ["success", "partial"]


def is_favicon(logo: Column) -> Column:
    """Whether a candidate without a role (struct url, source) is a page's small icon and no logo."""
    u, s = logo["url"], logo["source"]
    svg = u.rlike(r"(?i)\.svg(?:$|\?)") & u.rlike("(?i)logo|wordmark")
    icon = ~svg & (u.rlike(r"(?i)\.ico(?:$|\?)|favicon") | (s == "icon"))
    return F.coalesce(F.when(s.isin("og:image", "twitter:image"), ~u.rlike("(?i)logo|brand|wordmark")).when(s.isin("icon", "apple-touch-icon"), icon), F.lit(False))


def only_favicons(logos: Column) -> Column:
    """Whether there are candidates (url, source, logoRole) and none is more than a small icon or a social preview."""
    role = lambda x: F.coalesce(x["logoRole"], F.lit(""))
    by_role = F.forall(logos, lambda x: role(x).isin(*WEAK_LOGO_ROLES))
    return (F.size(logos) > 0) & F.when(F.exists(logos, lambda x: role(x) != ""), by_role).otherwise(F.forall(logos, is_favicon))


def quality_levels(name: Column, name_source: Column, logos: Column, n_services: Column, n_products: Column, blocked: Column, fetch_status: Column) -> Column:
    """struct(business_name, logo, services_products, overall): low, medium or high each; overall is the least of them.

    logos: array of (url, source, logoRole), best first. A blocked fetch that left nothing useful makes overall low.
    """
    top = F.get(logos, F.lit(0))
    of_name = F.when(trim(name) == "", "low").when(name_source == "claude", "high").when(name_source == "title", "medium").otherwise("low")
    of_logo = (
        F.when((F.size(logos) == 0) | only_favicons(logos), "low")
        .when(top["logoRole"] == "wordmark", "high")
        .when(top["logoRole"] == "icon_mark", "medium")
        .when(top["source"].isin(*STRONG_LOGO_SOURCES), "high")
        .otherwise("medium")
    )
    of_offers = F.when((n_services >= 2) | (n_products >= 2) | ((n_services >= 1) & (n_products >= 1)), "high").when(n_services + n_products >= 1, "medium").otherwise("low")
    useful = fetch_status.isin(*FETCHED) & ((F.size(logos) > 0) | (n_services > 0) | (n_products > 0))
    levels = F.array(of_name, of_logo, of_offers)
    least = F.when(F.array_contains(levels, "low"), "low").when(F.array_contains(levels, "medium"), "medium").otherwise("high")
    overall = F.when(blocked & ~F.coalesce(useful, F.lit(False)), "low").otherwise(least)
    return F.struct(of_name.alias("business_name"), of_logo.alias("logo"), of_offers.alias("services_products"), overall.alias("overall"))


# The codes of warnings, in their order, and what a fetch's diagnostics are called among them.
BLOCKED_CODE, FETCH_CODE, PARTIAL_CODE, CUT_CODE, SKIPPED_CODE = "site_blocked_static_fetch", "website_fetch_failed", "large_site_partial_extraction", "body_truncated", "claude_failed_or_skipped"
NAME_CODE, DOMAIN_NAME_CODE, LOGO_CODE, FAVICON_CODE, OFFER_CODE, EMPTY_CODE = "missing_business_name", "business_name_inferred_from_domain", "missing_logo_candidates", "favicon_only_logo_candidate", "missing_services_products", "low_content_extracted"
DEPTH_CODES = {c: c for c in ("scrape_depth_low", "pages_failed", "no_same_domain_links", "no_contact_pages_found", "timeout", "body_truncated")} | {"blocked": BLOCKED_CODE}
MOST_WARNINGS = 16


def warning_codes(fetch: Column, analysed: Column, name: Column, name_source: Column, logos: Column, n_services: Column, n_products: Column, has_contact: Column) -> Column:
    """Distinct codes of what makes an extraction less reliable, in order.

    fetch: struct(status, reason, blocked, diagnostics: array); analysed: whether the
    analysis ran and succeeded; logos: array of (url, source, logoRole).
    """
    given = F.create_map(*(F.lit(x) for pair in DEPTH_CODES.items() for x in pair))
    partial = (fetch["status"] == "partial") | F.coalesce(fetch["reason"] == "body_truncated", F.lit(False))
    no_offers, no_logos = (n_services == 0) & (n_products == 0), F.size(logos) == 0
    of_depth = F.transform(F.coalesce(fetch["diagnostics"], F.array().cast("array<string>")), lambda d: F.try_element_at(given, d))
    listed = F.concat(
        F.array(F.when(fetch["blocked"], BLOCKED_CODE), F.when(~fetch["status"].isin(*FETCHED), FETCH_CODE), F.when(partial, PARTIAL_CODE), F.when(partial, CUT_CODE)),
        of_depth,
        F.array(
            F.when(~analysed, SKIPPED_CODE),
            F.when(trim(name) == "", NAME_CODE).when(name_source == "domain", DOMAIN_NAME_CODE),
            F.when(no_logos, LOGO_CODE).when(only_favicons(logos), FAVICON_CODE),
            F.when(no_offers, OFFER_CODE),
            F.when(no_offers & ~has_contact & no_logos, EMPTY_CODE),
        ),
    )
    return F.array_distinct(F.array_compact(listed))


def merged_warnings(written: Column, codes: Column) -> Column:
    """Written warnings, then codes: trimmed, distinct, capped."""
    return distinct_capped(F.transform(F.concat(written, codes), trim), MOST_WARNINGS)
