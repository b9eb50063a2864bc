"""Predicates on review rows: which extracted fields are there.

Each takes a prefix of column names, so that it also works on a struct ('review.').
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgrain.functions import color, contact, status
from webgrain.functions.base import count_true, is_filled, trim
from webgrain.functions.text import json_strings

CONTACT_SIZES = ("emails", "phone_numbers", "addresses", "social_links")


def _c(prefix: str, name: str) -> Column:
    return F.coalesce(F.col(f"{prefix}{name}").cast("string"), F.lit(""))


def has_name(p: str = "") -> Column:
    return is_filled(_c(p, "extracted_business_name"))


def json_objects(c: Column) -> Column:
    """Items of a JSON list as JSON texts; other text gives none."""
    return F.coalesce(F.from_json(trim(c), "array<string>"), F.array().cast("array<string>"))


def has_logo(p: str = "") -> Column:
    count = F.coalesce(F.regexp_extract(trim(_c(p, "logo_candidate_count")), r"^(\d+)", 1).try_cast("int"), F.lit(0))
    return is_filled(_c(p, "selected_logo_url")) | (F.size(json_objects(_c(p, "logo_candidate_urls"))) > 0) | (count > 0)


def color_count(p: str = "") -> Column:
    return F.size(color.hex_list(_c(p, "extracted_color_hexes")))


def has_colors(p: str = "") -> Column:
    return (color_count(p) > 0) | is_filled(_c(p, "primary_color_hex")) | is_filled(_c(p, "secondary_color_hex"))


def has_email(p: str = "") -> Column:
    return F.exists(json_strings(_c(p, "extracted_emails")), lambda e: contact.email(e).isNotNull())


def has_phone(p: str = "") -> Column:
    return F.exists(json_strings(_c(p, "extracted_phone_numbers")), lambda e: contact.phone(e).isNotNull())


def has_address(p: str = "") -> Column:
    return F.size(json_strings(_c(p, "extracted_addresses"))) > 0


def has_plausible_address(p: str = "") -> Column:
    return F.exists(json_strings(_c(p, "extracted_addresses")), contact.is_plausible_address)


def has_social(p: str = "") -> Column:
    return F.size(json_objects(_c(p, "extracted_social_links"))) > 0


def has_offerings(p: str = "") -> Column:
    cells = (_c(p, c) for c in ("extracted_products", "extracted_services", "extracted_products_services"))
    return reduce(lambda a, b: a | b, (F.size(json_strings(c)) > 0 for c in cells))


def has_summary(p: str = "") -> Column:
    return is_filled(_c(p, "extracted_summary"))


#: The fields of coverage reports, in their order.
FIELDS = {
    "business_name": has_name,
    "logos": has_logo,
    "colors": has_colors,
    "emails": has_email,
    "phones": has_phone,
    "social": has_social,
    "address": has_address,
    "products_services": has_offerings,
    "summary": has_summary,
}


def field_filter(name: str) -> Column:
    """'has_emails', 'missing_colors' and so on."""
    how, _, field = name.partition("_")
    if field not in FIELDS or how not in ("has", "missing"):
        raise ValueError(f"no such filter: {name}")
    return FIELDS[field]() if how == "has" else ~FIELDS[field]()


def is_processed() -> Column:
    return status.status(_c("", "status")) != "not_run"


def matches_filters(names: list[str]) -> Column:
    """All filters hold; rows that were not processed match none (and with no filter, all rows match)."""
    return reduce(lambda a, b: a & b, (field_filter(n) & is_processed() for n in names), F.lit(True))


def matches_search(query: str, columns: list[str]) -> Column:
    """The query occurs in the columns, whatever the case; a blank one matches all."""
    text = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))
    q = query.strip().lower()
    return text.contains(q) if q else F.lit(True)


def needs_work() -> Column:
    """Failed, or a success that lacks name, logo or colours."""
    s = status.status(_c("", "status"))
    return (s == "failed") | ((s == "success") & ~(has_name() & has_logo() & has_colors()))


def contact_score(p: str = "") -> Column:
    """0 to 4: e-mail, phone, plausible address, social link."""
    return count_true(has_email(p), has_phone(p), has_plausible_address(p), has_social(p))


def is_fetch_blocked() -> Column:
    message = _c("", "error_message")
    return (status.status(_c("", "status")) == "failed") & message.rlike(r"(?<!\d)(401|403|405|429|451)(?!\d)")


def needs_palette_backfill() -> Column:
    return has_colors() & ~is_filled(_c("", "palette_source"))


def backfilled_palette() -> Column:
    """struct(source, confidence) for rows with colours and no source: two to six colours without roles look like a logo's."""
    n = color_count()
    from_logo = n.between(2, 6) & ~is_filled(_c("", "primary_color_hex")) & ~is_filled(_c("", "secondary_color_hex"))
    return F.when(from_logo, F.struct(F.lit("logo").alias("source"), F.lit("medium").alias("confidence"))).otherwise(
        F.struct(F.lit("extraction").alias("source"), F.lit("unknown").alias("confidence"))
    )
