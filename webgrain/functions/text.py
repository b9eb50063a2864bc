"""Text: URLs in prose, excerpts, tokens, lists, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgrain.functions.base import distinct_ignoring_case, filled, trim
from webgrain.functions.url import BARE_TLDS, is_bare_domain, strip_punctuation

_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
#: Word bounds in the sense of ASCII letters, digits and underscore.
_FROM, _TO = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
HTTP_URL = r"""(?i)https?://[^\s<>"']+"""
EMAIL = rf"(?i){_FROM}[a-z0-9._%+-]+@{_LABEL}(?:\.{_LABEL})+{_TO}"
WWW_DOMAIN = rf"(?i){_FROM}www\.{_LABEL}\.(?:{BARE_TLDS}){_TO}"
BARE_DOMAIN = rf"(?i){_FROM}{_LABEL}\.(?:{BARE_TLDS}){_TO}"


def http_urls(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(HTTP_URL), F.lit(0))


def mask_urls_and_emails(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), HTTP_URL, " "), EMAIL, " ")


def bare_domains(c: Column) -> Column:
    """Hosts without a scheme: those with www. first, then the rest; distinct whatever the case."""
    masked = mask_urls_and_emails(c)
    found = F.concat(*(F.regexp_extract_all(masked, F.lit(r), F.lit(0)) for r in (WWW_DOMAIN, BARE_DOMAIN)))
    return distinct_ignoring_case(F.filter(F.transform(found, strip_punctuation), is_bare_domain))


def urls_in_text(c: Column) -> Column:
    return F.concat(http_urls(c), bare_domains(c))


def excerpt(c: Column, most: int = 240) -> Column:
    """White space squeezed; a longer text ends in an ellipsis."""
    t = trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s ]+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def tokens(c: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits of over two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 2))


def overlap_hint(a: Column, b: Column) -> Column:
    """high, partial or low by the shared part of the larger token set; '' if one is empty."""
    x, y = tokens(a), tokens(b)
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), "").when(share >= 0.5, "high").when(share >= 0.2, "partial").otherwise("low")


def title_overlap_hint(title: Column, name: Column) -> Column:
    a, b = F.lower(trim(title)), F.lower(trim(name))
    return F.when((a == "") | (b == ""), "").when(a.contains(b) | b.contains(a), "high").otherwise(overlap_hint(title, name))


#: The outline of a JSON value. Spark's own check passes over what follows a first value.
JSON_SHAPE = r'(?s)^(\[.*\]|\{.*\}|".*"|-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null)$'


def is_json(c: Column) -> Column:
    """Whether the trimmed text is one JSON value."""
    t = trim(c)
    return F.try_parse_json(t).isNotNull() & t.rlike(JSON_SHAPE)


def json_strings(c: Column) -> Column:
    """A JSON list's items as trimmed strings; other JSON gives none; no JSON is split at ; , | and ·."""
    t = trim(c)
    listed = F.filter(F.transform(F.from_json(t, "array<string>"), trim), lambda x: x != "")
    parts = F.filter(F.transform(F.split(t, r"[;,|·]"), trim), lambda x: x != "")
    nothing = F.array().cast("array<string>")
    valid = is_json(t)
    return F.when(t == "", nothing).when(valid & t.startswith("["), F.coalesce(listed, nothing)).when(valid, nothing).otherwise(parts)


def split_list(c: Column, most: int = 8, longest: int = 120) -> Column:
    items = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;·•|]"), lambda x: F.substring(trim(F.regexp_replace(x, r"\s+", " ")), 1, longest))
    return F.slice(distinct_ignoring_case(F.filter(items, lambda x: x != "")), 1, most)


def append_source(sources: Column, new: Column) -> Column:
    """A '; ' list with one more name, if it is new."""
    have = F.filter(F.transform(F.split(F.coalesce(sources, F.lit("")), ";"), trim), lambda x: x != "")
    return F.array_join(F.array_distinct(F.concat(have, F.filter(F.array(trim(new)), lambda x: x != ""))), "; ")


def comparable(c: Column) -> Column:
    """Trimmed, lower-case, without scheme, www. and end slashes."""
    t = F.regexp_replace(F.lower(trim(c)), "^https?://", "")
    return F.regexp_replace(F.regexp_replace(t, r"^www\.", ""), "/+$", "")


def brand_tokens_from_title(c: Column) -> Column:
    """Words of two characters or more of the title's first segment."""
    first = F.regexp_extract(F.lower(trim(c)), r"^([^|–—:\-]*)", 1)
    stop = ["the", "and", "for", "home", "welcome", "official", "website", "site", "page", "inc", "llc", "ltd", "co"]
    return F.array_distinct(F.filter(F.split(first, "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*stop)))


def name_from_domain(host: Column) -> Column:
    """'my-shop.com' is 'My Shop'."""
    label = F.regexp_extract(F.regexp_replace(F.lower(trim(host)), r"^www\.", ""), r"^([^.]*)", 1)
    return F.initcap(trim(F.regexp_replace(label, r"[-_]+", " ")))


def is_mostly_duplicate(a: Column, b: Column) -> Column:
    """Both of 80 characters or more, and one holds the other's first 240."""
    x, y = trim(a), trim(b)
    return (F.length(x) >= 80) & (F.length(y) >= 80) & (F.contains(x, F.substring(y, 1, 240)) | F.contains(y, F.substring(x, 1, 240)))


def redact_error(c: Column) -> Column:
    """An error message without addresses: URLs become [url], host paths [path]."""
    t = F.regexp_replace(trim(c), r"(?i)https?://[^\s)]+", "[url]")
    return trim(F.regexp_replace(t, r"(?i)[a-z0-9-]+\.(com|net|org|io)/[^\s)]+", "[path]"))


def join_texts(*cs: Column) -> Column:
    return F.concat_ws("\n\n", *(filled(c) for c in cs))


def initials(c: Column) -> Column:
    words = F.filter(F.split(trim(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    two = F.upper(F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.substring(F.get(words, F.lit(1)), 1, 1)))
    return F.coalesce(two, F.upper(F.substring(F.get(words, F.lit(0)), 1, 2)), F.lit(""))
