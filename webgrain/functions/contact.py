"""E-mail addresses, phone numbers, postal addresses and social links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgrain.functions import href
from webgrain.functions.base import all_of, distinct_by, distinct_ignoring_case, filled, trim
from webgrain.functions.text import EMAIL, is_json

EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def emails_in_text(c: Column) -> Column:
    """Distinct lower-case addresses in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), F.lit(0)), F.lower))


def phones_in_text(c: Column) -> Column:
    """Runs of digits, blanks and phone punctuation with 7 to 15 digits, distinct by digits."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![\w.])[+(]?\d[\d().\- ]{5,18}\d(?![\w])"), F.lit(0))
    return distinct_by(F.filter(runs, lambda p: F.length(phone_digits(p)).between(7, 15)), phone_digits)


def email(c: Column) -> Column:
    """Trimmed and lower-case, or null if it has no e-mail shape."""
    t = F.lower(trim(c))
    return F.when(t.rlike(EMAIL_SHAPE), t)


def scraped_email(c: Column) -> Column:
    """As email, without mailto: and what follows a question mark; '' if it has no e-mail shape."""
    t = trim(c)
    t = F.when(t.rlike("^(?i)mailto:"), trim(F.regexp_extract(F.substring(t, 8, 1 << 20), r"^([^?]*)", 1))).otherwise(t)
    return F.coalesce(email(t), F.lit(""))


def phone(c: Column) -> Column:
    """The trimmed text if it has phone characters only and seven digits or more, else null."""
    t = trim(c)
    return F.when(t.rlike(r"^(?i)[\d\s().+\-xext]+$") & (F.length(phone_digits(t)) >= 7), t)


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")


def phone_display(c: Column) -> Column:
    """(aaa) bbb-cccc for 10 digits without a country's +, +1 before that for 11 with a 1, else squeezed."""
    t = trim(F.regexp_replace(trim(c), "^(?i)tel:", ""))
    d = phone_digits(t)
    ten = lambda at: F.concat(F.lit("("), F.substring(d, at, 3), F.lit(") "), F.substring(d, at + 3, 3), F.lit("-"), F.substring(d, at + 6, 4))
    return (
        F.when((F.length(d) == 10) & ~t.startswith("+"), ten(1))
        .when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+1 "), ten(2)))
        .otherwise(trim(F.regexp_replace(t, r"\s+", " ")))
    )


def distinct_emails(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, scraped_email), lambda e: e != ""))


def distinct_phones(items: Column) -> Column:
    shown = F.filter(F.transform(items, phone_display), lambda p: F.length(phone_digits(p)) >= 7)
    return distinct_by(shown, phone_digits)


def distinct_addresses(items: Column) -> Column:
    squeezed = F.transform(items, lambda a: trim(F.regexp_replace(a, r"\s+", " ")))
    return distinct_ignoring_case(F.filter(squeezed, lambda a: F.length(a) >= 12))


def _parts(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "[,;|]")


def phone_field(c: Column) -> Column:
    return F.array_join(distinct_phones(_parts(c)), ", ")


def email_field(c: Column) -> Column:
    return F.array_join(distinct_emails(_parts(c)), ", ")


def tel_href(c: Column) -> Column:
    digits = F.regexp_replace(phone(c), r"[^\d+]", "")
    return F.when(F.length(digits) >= 7, F.concat(F.lit("tel:"), digits))


def social_label(url: Column) -> Column:
    u = F.lower(url)
    has = lambda *parts: F.coalesce(u.rlike("|".join(parts)), F.lit(False))
    return (
        F.when(has("instagram"), "Instagram")
        .when(has("facebook", r"fb\.com"), "Facebook")
        .when(has("linkedin"), "LinkedIn")
        .when(has("twitter", r"x\.com"), "X")
        .when(has("youtube", r"youtu\.be"), "YouTube")
        .when(has("tiktok"), "TikTok")
        .otherwise("Other")
    )


def is_plausible_address(c: Column) -> Column:
    """No social link, scraping noise or URL; and two digits on end, a street word, state and zip, or 14 characters."""
    t, low = trim(c), F.lower(trim(c))
    street = r"(?i)(?<!\w)(street|st\.?|avenue|ave\.?|road|rd\.?|blvd|boulevard|suite|ste\.?|drive|dr\.?|lane|ln\.?|way|parkway|pkwy)(?!\w)"
    looks = t.rlike(r"\d{2,}") | t.rlike(street) | t.rlike(r"(?<!\w)[A-Z]{2}\s+\d{5}(-\d{4})?(?!\w)") | (F.length(t) >= 14)
    return all_of(
        t != "",
        ~low.rlike(r"facebook\.com|instagram\.com|twitter\.com|x\.com|linkedin\.com|youtube\.com|tiktok\.com"),
        ~low.rlike("social handle|uploaded assets|graphic provided"),
        ~low.rlike("^https?://"),
        looks,
    )


def postal_address(*parts: Column) -> Column:
    """Two parts or more, joined, of 12 to 240 characters; else null."""
    have = F.filter(F.array(*(trim(p) for p in parts)), lambda p: p != "")
    text = F.array_join(have, ", ")
    return F.when((F.size(have) >= 2) & F.length(text).between(12, 240), text)


def is_profile_url(url: Column) -> Column:
    """A social address that names a profile, not a share, watch or post page."""
    u = F.lower(trim(url))
    page = u.rlike(r"/(sharer?|share|intent|watch|hashtag|explore|search|login|signup|plugins|dialog|p|reel|status|embed|posts?)(/|\?|\.php|$)")
    path = F.regexp_extract(u, r"^https?://[^/]+/+([^?#]*)", 1)
    return (social_label(u) != "Other") & ~page & (F.regexp_replace(path, "/+$", "") != "")


def profile_urls(urls: Column, most: int = 8) -> Column:
    return F.slice(distinct_by(F.filter(urls, is_profile_url), lambda u: F.regexp_replace(F.lower(u), r"[?#].*$|/+$", "")), 1, most)


_LINK = "struct<url: string, href: string, label: string, platform: string>"


def _links(cell: Column, label) -> Column:
    """(label, url) of the items of a JSON list, texts or objects, whose address may be opened; label(item, url) names it."""
    items = F.when(is_json(cell) & trim(cell).startswith("["), F.from_json(trim(cell), "array<string>"))

    def read(x: Column) -> Column:
        given = F.when(x.startswith("{"), F.from_json(x, _LINK))
        return F.struct(given.alias("given"), href.safe(F.when(given.isNull(), x).otherwise(F.coalesce(given["url"], given["href"]))).alias("url"))

    found = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), read), lambda v: v["url"].isNotNull())
    return F.transform(found, lambda v: F.struct(label(v["given"], v["url"]).alias("label"), v["url"].alias("url")))


def social_links(cell: Column) -> Column:
    """(label, url) of a JSON list of social links; a label is its own, else its platform, else from the address. No JSON gives none."""
    return _links(cell, lambda given, url: F.coalesce(filled(given["label"]), filled(given["platform"]), social_label(url)))


def contact_links(cell: Column) -> Column:
    """(label, url) of a JSON list of links; label is null where none is given. No JSON gives none."""
    return _links(cell, lambda given, _: filled(given["label"]))
