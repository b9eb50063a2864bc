r"""URLs, hosts and site keys.

A URL is split by one regular expression, so that all engines agree on it; paths and
queries are written as the URL standard has them (see href). Punycode is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgrain.functions import href as H
from webgrain.functions.base import filled, first_filled, let, none, trim

#: Query parameters that only track.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
#: Top-level domains of hosts without a scheme.
BARE_TLDS = "com|org|net|co|io|edu|gov|us|uk|ca|au|de|fr|biz|info|shop|store|app|dev|ai|me|tv|cc|xyz"

_PARTS = r"^(?i:(https?))://([^/?#:@\s]+)(:\d+)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def strip_punctuation(c: Column) -> Column:
    """Without the punctuation that clings to URLs in running text."""
    return F.regexp_replace(F.regexp_replace(trim(c), r"""[.,;:!?)\]"']+$""", ""), r"""^[(\["']+""", "")


def with_scheme(c: Column) -> Column:
    """The text with https:// if it has no scheme; null if it cannot be a URL."""
    bare = F.when(~c.contains(" ") & c.contains("."), F.concat(F.lit("https://"), F.regexp_replace(c, r"^/+", "")))
    return F.when(c.rlike(r"^(?i)https?://"), c).otherwise(bare)


def _query_pairs(query: Column) -> Column:
    """The parameters of '?a=b&c' as structs (k, v)."""
    pairs = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")))


def _decoded(c: Column) -> Column:
    """A name or value of a form; one that is no proper encoding stays."""
    return F.when(c.rlike("[%+]"), F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))).otherwise(c)


def _encoded(c: Column) -> Column:
    return F.when(c.rlike("[^A-Za-z0-9*._-]"), F.url_encode(c)).otherwise(c)


def sorted_query(query: Column) -> Column:
    """The query without tracking parameters, sorted by key and value, encoded as forms are; '' if nothing is left."""
    read = F.transform(_query_pairs(query), lambda p: F.struct(_decoded(p["k"]).alias("k"), _decoded(p["v"]).alias("v")))
    kept = F.array_sort(F.filter(read, lambda p: ~p["k"].isin(*TRACKING_PARAMS)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.regexp_replace(text, "^(?=.)", "?")


def _drop_end_slash(path: Column) -> Column:
    return F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)


def _split(href: Column) -> Column:
    """struct(scheme, host, port, path, query, fragment); null if href is no http(s) URL."""
    names = ["scheme", "host", "port", "path", "query", "fragment"]
    parts = F.struct(*((F.lower(_part(href, k)) if k < 3 else _part(href, k)).alias(n) for k, n in enumerate(names, 1)))
    return F.when(href.rlike(_PARTS), parts)


def normalize(c: Column) -> Column:
    """One spelling for each URL: lower-case scheme and host, no port, fragment, tracking or end slash, sorted query."""
    blocked = r"^(?i)(javascript|data|vbscript|file|mailto):|@|^$"

    def spell(p: Column) -> Column:
        bare = (p["path"] == "/") & (p["query"] == "")
        return F.concat(p["scheme"], F.lit("://"), p["host"], F.when(bare, "").otherwise(p["path"]), p["query"])

    def tidy(p: Column) -> Column:
        path = let(_drop_end_slash(H.clean_path(p["path"])), lambda x: F.when(x == "", "/").otherwise(x))
        return F.when(p.isNotNull(), F.struct(p["scheme"].alias("scheme"), p["host"].alias("host"), path.alias("path"), sorted_query(p["query"]).alias("query")))

    href = let(strip_punctuation(c), lambda raw: F.when(~raw.rlike(blocked), with_scheme(raw)))
    return let(let(let(href, _split), tidy), spell)


def normalize_weak(c: Column) -> Column:
    """Lower-case host only; path, query, fragment and slashes stay, an empty path is '/'."""
    href = let(strip_punctuation(c), lambda raw: F.when((raw != "") & ~raw.contains("@"), with_scheme(raw)))

    def spell(p: Column) -> Column:
        path = F.when(p["path"] == "", "/").otherwise(p["path"])
        return F.concat(p["scheme"], F.lit("://"), p["host"], p["port"], path, p["query"], p["fragment"])

    return let(let(href, _split), spell)


def domain(normalized: Column) -> Column:
    """Lower-case host of a URL, or ''."""
    return F.lower(_part(F.coalesce(normalized, F.lit("")), 2))


def canonical_domain(host: Column) -> Column:
    """Trimmed, lower-case, without one leading www."""
    return F.regexp_replace(F.lower(trim(host)), r"^www\.", "")


def host_of(c: Column) -> Column:
    """A lenient host: of a URL with or without scheme, else what stands before a slash."""

    def find(t: Column) -> Column:
        rough = F.regexp_extract(F.regexp_replace(t, r"^(?i)www\.", ""), "^([^/]*)", 1)
        host = F.lower(_part(F.when(t.rlike(r"^(?i)https?://"), t).otherwise(F.concat(F.lit("https://"), t)), 2))
        return F.when(host != "", host).otherwise(rough)

    return let(trim(c), find)


def domain_key(canonical: Column, dom: Column, normalized: Column, raw: Column) -> Column:
    """Host key from the first field that has one; null if none has."""
    pick = F.coalesce(filled(canonical), filled(dom), filled(host_of(normalized)), filled(host_of(raw)))
    return canonical_domain_or_null(pick)


def canonical_domain_or_null(c: Column) -> Column:
    return F.when(c.isNotNull(), canonical_domain(c))


def site_key(canonical: Column, dom: Column, normalized: Column, raw: Column) -> Column:
    """'site:host' for a root, 'path:host/path?query' else; www. and end slashes do not count."""
    url = first_filled(normalized, raw)
    parts = let(let(url, lambda u: F.when(u.rlike(r"^(?i)https?://"), u).otherwise(F.concat(F.lit("https://"), u))), _split)

    def name(v: Column) -> Column:
        p, key = v["p"], v["key"]
        site = F.coalesce(filled(canonical_domain(p["host"])), key)
        tail = let(_drop_end_slash(p["path"]), lambda x: F.when(x.isin("", "/"), "").otherwise(F.concat(x, p["query"])))
        return (
            F.when(p.isNull(), F.concat(F.lit("site:"), key))
            .when(p["path"].rlike("^/*$"), F.concat(F.lit("site:"), F.coalesce(site, F.lit(""))))
            .otherwise(F.concat(F.lit("path:"), site, tail))
        )

    return let(F.struct(parts.alias("p"), domain_key(canonical, dom, normalized, raw).alias("key")), name)


def is_www(c: Column) -> Column:
    return trim(c).rlike(r"^(?i)(https?://)?www\.")


def is_bare_domain(host: Column) -> Column:
    """At least two labels, a known top level, a letter in the label before it, labels of 1 to 63 characters."""
    h = F.regexp_replace(F.lower(host), r"^www\.", "")
    parts = F.filter(F.split(h, r"\."), lambda p: p != "")
    second = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    top = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return (F.size(parts) >= 2) & top.rlike(f"^({BARE_TLDS})$") & second.rlike("[a-z]") & F.forall(parts, lambda p: F.length(p) <= 63)


def _kind(p: Column) -> Column:
    """struct(n, plain): path segments, and whether there is no query."""
    return F.struct(F.size(F.filter(F.split(p["path"], "/"), lambda s: s != "")).alias("n"), p["query"].isin("", "?").alias("plain"), F.greatest(F.length(p["path"]), F.lit(1)).alias("chars"))


def _shape(c: Column) -> Column:
    return let(let(let(trim(c), with_scheme), _split), lambda p: F.when(p.isNotNull(), _kind(p)))


def _type_of(k: Column) -> Column:
    return F.when(k["plain"] & (k["n"] == 0), "root").when(k["plain"] & (k["n"] == 1), "shallow").otherwise("deep")


def path_type(c: Column) -> Column:
    """root (no path, no query), shallow (one segment, no query) or deep; what is no URL is deep."""
    return let(_shape(c), _type_of)


def priority(c: Column) -> Column:
    """Less is better: 0, 1000 or 2000 by type, 100 a segment, 1 a character of the path, 500 for a query."""

    def score(k: Column) -> Column:
        base = F.when(_type_of(k) == "root", 0).when(_type_of(k) == "shallow", 1000).otherwise(2000)
        return F.when(k.isNull(), F.lit(2**53 - 1)).otherwise((base + 100 * k["n"] + k["chars"] + F.when(k["plain"], 0).otherwise(500)).cast("long"))

    return let(_shape(c), score)


def dedupe_key(normalized: Column, raw: Column, dom: Column) -> Column:
    return F.coalesce(normalize(normalized), normalize(raw), normalize(dom))


def safe_href(c: Column) -> Column:
    """An http(s) address to open, or null."""
    return H.safe(c)


def host_only(c: Column) -> Column:
    """'https://host' and no more, for publishing; null without a host."""
    host = canonical_domain(host_of(c))
    return F.when(host.contains("."), F.concat(F.lit("https://"), host))


def display_parts(c: Column) -> Column:
    """struct(href, url, host, path) of a source URL."""
    href = safe_href(c)
    path = F.concat(_drop_end_slash(_part(href, 4)), _part(href, 5))
    return F.struct(href.alias("href"), trim(c).alias("url"), canonical_domain(_part(href, 2)).alias("host"), F.when(path == "/", "").otherwise(path).alias("path"))


def comparable_domain(c: Column) -> Column:
    """Host without www., or bare text with a dot; else null."""
    host = canonical_domain(host_of(c))
    return F.when(host.contains(".") & ~host.contains(" "), host)


def is_new_website(before: Column, after: Column) -> Column:
    a, b = comparable_domain(before), comparable_domain(after)
    return F.coalesce(a != b, F.lit(False))


def page_key(c: Column) -> Column:
    """Lower-case URL without fragment and end slashes; the port stays."""
    return F.regexp_replace(F.lower(F.regexp_replace(trim(c), "#.*$", "")), "/+$", "")


def same_host(a: Column, b: Column) -> Column:
    x, y = canonical_domain(_part(a, 2)), canonical_domain(_part(b, 2))
    return (x != "") & (x == y)


def page_type(path: Column) -> Column:
    """about, contact, portfolio, services or other, from the path, in that order."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"about|our-story|company|who-we|team(?![a-z0-9_])"), "about")
        .when(p.rlike("contact|locations?|offices?|get-in-touch|reach-us"), "contact")
        .when(p.rlike("portfolio|our-work|^/work|case-stud"), "portfolio")
        .when(p.rlike("service|product|solution|offering|menu|shop|store|catalog"), "services")
        .otherwise("other")
    )


#: Words that make a link worth a visit, and what makes it noise.
LINK_WORDS = ["about", "contact", "service", "product", "portfolio", "work", "team", "story", "menu", "shop", "location"]
LINK_NOISE = "privacy|terms|cookie|legal|gdpr|login|sign[-_]?in|sign[-_]?up|cart|checkout|account/|wp-admin"


def link_score(path_and_query: Column) -> Column:
    """12 for each word of LINK_WORDS, 25 off for noise."""
    t = F.lower(path_and_query)
    words = sum((F.when(t.contains(w), 12).otherwise(0) for w in LINK_WORDS), F.lit(0))
    return words - F.when(t.rlike(LINK_NOISE), 25).otherwise(0)


def export_url(c: Column) -> Column:
    """A website column of an export: http(s) as it is, else with https:// if it has a dot and no blank."""
    t = trim(c)
    return F.when(t.rlike(r"^(?i)https?://"), t).when((t != "") & ~t.rlike(r"\s") & t.contains("."), F.concat(F.lit("https://"), t))


def resolve_export_url(columns: list[str]) -> Column:
    """struct(url, source) of the first column that holds a website; both null if none does."""
    found = [F.when(export_url(F.col(c)).isNotNull(), F.struct(export_url(F.col(c)).alias("url"), F.lit(c).alias("source"))) for c in columns]
    return F.coalesce(*found, F.struct(none("string").alias("url"), none("string").alias("source")))


def is_private_host(host: Column) -> Column:
    """localhost, .local and addresses of private, loopback or link-local networks."""
    h = F.regexp_replace(F.lower(trim(host)), r"^\[|\]$", "")
    v4 = r"^(10|127|0)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$"
    return h.isin("localhost", "::1") | h.rlike(r"\.(local|localhost|internal)$") | h.rlike(v4) | h.rlike(r"^(fc|fd|fe80)[0-9a-f]*:")


def manual_url(c: Column) -> Column:
    """A URL that someone typed: with scheme, host with a dot, no private host; else null."""
    href = with_scheme(trim(c))
    host = _part(href, 2)
    return F.when(href.rlike(_PARTS) & host.contains(".") & ~is_private_host(host), href)
