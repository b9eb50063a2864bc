"""Review rows from extraction records: JSON documents without a fixed schema, walked and routed.

One Arrow pass turns a record into its leaves, in document order and at any depth, each
with the keys on its way. What a leaf is (an address, a product, a colour) is
then decided by native expressions over that array: which root it lies under, what
its nearest key says, what shape its text has; first ones are kept, lists capped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from webgrain.functions import color, contact, href, text
from webgrain.functions import url as U
from webgrain.functions.base import any_of, filled, first_by, is_filled, let, trim

# Where records keep what, in the order of precedence, and how much of it a row holds.
CONTACT_ROOTS = [
    ("content", "contact"), ("contact",), ("emails",), ("phoneNumbers",), ("socialLinks",), ("socials",), ("addresses",),
    ("locations",), ("contactLinks",), ("links",),
]
WEBSITES = [("business", "website"), ("business", "canonicalUrl")]
CONTACT_CAPS = {"email": 8, "phone": 8, "social": 12, "address": 4, "link": 8}
OFFERING_ROOTS = [("content",), ("business",), ("brand",), ("extracted",), ("designSpec",)]
OFFERING_KEY = "(?i)^(products?|services?|offerings?|productservices|productsandservices)$"
OFFERING_CAPS = {"products": 24, "services": 24, "combined": 32}
LONGEST_OFFERING, LONGEST_SHORT = 160, 8
COLOR_ROOTS = [
    *(("brand", k) for k in ("colors", "brandColors", "palette", "primaryColor", "secondaryColor", "accentColor", "extractedColors")),
    ("colors",), ("brandColors",), ("extractedColors",), ("palette",), ("designSpec", "brandColors"), ("designSpec", "colors"),
    ("visualIdentity", "colors"), ("visualIdentity", "palette"), ("metadata", "colorBackground"), ("metadata", "colorAccent"), ("metadata", "colorText"),
]
COLOR_LABEL = "(?i)primary|secondary|accent|neutral|background|teal|navy"
SECOND_COLOR = "secondary|accent|teal|navy"
COLOR_PATHS = ["brand.colors", "brand.brandColors", "palette", "colors", "designSpec.brandColors", "visualIdentity.colors", "metadata.colors"]
PALETTE_OWNERS = [("brand",), (), ("visualIdentity",), ("designSpec",), ("metadata",)]
SOURCE_KEYS = ["paletteSource", "palette_source", "colorsSource", "colorSource"]
CONFIDENCE_KEYS = ["paletteConfidence", "palette_confidence"]
LOGO_WARNING = r"(?i)derived from logo|logo image \(palette fallback\)"
NAME_KEYS = ("name", "title", "label")
MOST_COLORS, MOST_LOGOS, MOST_SUMMARY = 4, 5, 4

_LEAF = pa.struct([("path", pa.list_(pa.string())), ("kind", pa.string()), ("text", pa.string()), ("named", pa.int32())])
LEAVES = T.ArrayType(
    T.StructType([
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("named", T.IntegerType()),
    ])
)

_TOKEN = re.compile(r'[\s]*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*+")|([^\s\[\]{},:"]++))', re.DOTALL)


def parse(document: str):
    """A JSON value nested to any depth; ValueError if the text is none."""
    try:
        return json.loads(document)
    except RecursionError:
        return _parse_deep(document)


def _parse_deep(document: str):
    """As json.loads, with a stack of its own."""
    at, stack, key, root, wants = 0, [], [], [], "value"
    end = len(document.rstrip())
    while at < end:
        found = _TOKEN.match(document, at)
        if not found:
            raise ValueError(f"no JSON at {at}")
        at, (mark, quoted, plain) = found.end(), found.groups()
        if wants == "value" and (mark in ("[", "{") or quoted or plain):
            value = {} if mark == "{" else [] if mark == "[" else json.loads(quoted or plain)
            if not stack:
                root.append(value)
            elif isinstance(stack[-1], dict):
                stack[-1][key.pop()] = value
            else:
                stack[-1].append(value)
            if mark:
                stack.append(value)
            wants = "key or end" if mark == "{" else "value or end" if mark == "[" else "next"
            wants = "value" if wants == "value or end" and (n := _TOKEN.match(document, at)) and n[1] != "]" else wants
        elif wants in ("key", "key or end") and quoted:
            key.append(json.loads(quoted))
            wants = "colon"
        elif wants == "colon" and mark == ":":
            wants = "value"
        elif wants == "next" and mark == "," and stack:
            wants = "key" if isinstance(stack[-1], dict) else "value"
        elif wants in ("next", "key or end", "value or end") and stack and mark == ("}" if isinstance(stack[-1], dict) else "]"):
            stack.pop()
            wants = "next"
        else:
            raise ValueError(f"no JSON at {at}")
    if stack or not root:
        raise ValueError("JSON ends early")
    return root[0]


def _children(value: dict) -> Iterator[tuple[str, object]]:
    """Members in the order of the format: whole numbers first, by value."""
    numbers = sorted((k for k in value if k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1), key=int)
    yield from ((k, value[k]) for k in numbers)
    yield from ((k, v) for k, v in value.items() if k not in set(numbers)) if numbers else value.items()


def _shown(value) -> tuple[str, str]:
    if isinstance(value, str):
        return "string", value
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    return "number", str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)


def leaves_of(value) -> list[tuple[list[str | None], str, str, int]]:
    """(path, kind, text, named) of all strings, numbers and booleans, in order.

    path holds the keys, and null for a step into a list. named is the length of the
    longest way on it to an object with a name (its first text among name, title and
    label, if not blank) that is not this leaf; -1 if there is none.
    """
    out, todo = [], [((), value, -1)]
    while todo:
        path, value, named = todo.pop()
        if isinstance(value, dict):
            name = next((k for k in NAME_KEYS if isinstance(value.get(k), str)), None)
            name = name if name and value[name].strip() else None
            todo += reversed([((*path, k), v, named if name in (None, k) else len(path)) for k, v in _children(value)])
        elif isinstance(value, list):
            todo += [((*path, None), v, named) for v in reversed(value)]
        elif value is not None:
            out.append((list(path), *_shown(value), named))
    return out


@arrow_udf(LEAVES)
def leaves(documents: pa.Array) -> pa.Array:
    """The leaves of JSON texts; null for what is no JSON."""
    rows = []
    for document in documents.to_pylist():
        try:
            rows.append(None if document is None else [dict(zip(("path", "kind", "text", "named"), leaf, strict=True)) for leaf in leaves_of(parse(document))])
        except ValueError:
            rows.append(None)
    return pa.array(rows, pa.list_(_LEAF))


def _path(keys: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(k) for k in keys)).cast("array<string>")


def under(found: Column, root: tuple[str, ...]) -> Column:
    """The string leaves at or below a root, as (text, keys: those below it, null for a list step, named)."""
    n = len(root)
    own = F.filter(found, lambda x: (x["kind"] == "string") & F.coalesce(F.slice(x["path"], 1, n) == _path(root), F.lit(False)) if n else x["kind"] == "string")
    return F.transform(own, lambda x: F.struct(x["text"].alias("text"), F.slice(x["path"], F.lit(n + 1), F.greatest(F.size(x["path"]) - n, F.lit(0))).alias("keys"), (x["named"] >= n).alias("hidden")))


#: Stands between the keys of a way in the maps of members(); a key that holds it is no way there.
_STEP = "\x1f"


def members(found: Column, kind: str = "string") -> Column:
    """Map from way to text of the leaves of a kind that no list holds."""
    plain = F.filter(found, lambda x: (x["kind"] == kind) & F.forall(x["path"], lambda k: F.coalesce(~k.contains(_STEP), F.lit(False))))
    return F.map_from_entries(F.transform(plain, lambda x: F.struct(F.array_join(x["path"], _STEP), x["text"])))


def member(known: Column, *keys: str) -> Column:
    """The text at a way in a map of members(); null if there is none."""
    return F.try_element_at(known, F.lit(_STEP.join(keys)))


def _last_key(keys: Column) -> Column:
    return F.try_element_at(F.filter(keys, lambda k: k.isNotNull()), F.lit(-1))


def _squeezed(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"[\s\x{00a0}\x{feff}]+", " "))


def contact_tokens(found: Column, texts: Column) -> Column:
    """Array of (kind, value, label) of all texts under the contact roots, in order: email, phone, social, link or address.

    texts: members(found).
    """

    def sort_out(x: Column) -> Column:
        t = trim(x["text"])
        made = F.struct(t.alias("t"), contact.email(t).alias("email"), contact.phone(t).alias("phone"), href.safe(t).alias("url"), _last_key(x["keys"]).alias("hint"))

        def choose(v: Column) -> Column:
            label = contact.social_label(v["url"])
            kind = (
                F.when(v["t"] == "", F.lit(None).cast("string"))
                .when(v["email"].isNotNull(), "email")
                .when(v["phone"].isNotNull(), "phone")
                .when(v["url"].isNotNull(), F.when(label != "Other", "social").otherwise("link"))
                .when(F.length(v["t"]) > LONGEST_SHORT, "address")
            )
            value = F.coalesce(v["email"], v["phone"], v["url"], _squeezed(v["t"]))
            return F.struct(kind.alias("kind"), value.alias("value"), F.when(kind == "social", label).when(kind == "link", filled(v["hint"])).alias("label"))

        return let(made, choose)

    walked = F.transform(F.concat(*(under(found, root) for root in CONTACT_ROOTS)), sort_out)
    sites = F.array(*(F.struct(F.coalesce(*(member(texts, *at, *more) for more in ((), ("url",), ("href",)))).alias("text"), member(texts, *at, "label").alias("label")) for at in WEBSITES))
    links = F.transform(sites, lambda x: F.struct(F.lit("link").alias("kind"), href.safe(x["text"]).alias("value"), F.coalesce(filled(x["label"]), F.lit("Website")).alias("label")))
    return F.concat(walked, F.filter(links, lambda x: x["value"].isNotNull()))


def _cell(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.to_json(items)).otherwise("")


def contact_cells(tokens: Column) -> dict[str, Column]:
    """The contact columns of a row from contact_tokens."""
    keys = {"email": lambda x: x["value"], "phone": lambda x: contact.phone_digits(x["value"]), "address": lambda x: F.lower(x["value"])}

    def of(kind: str) -> Column:
        own = F.filter(tokens, lambda x: x["kind"] == kind)
        return first_by(own, keys.get(kind, lambda x: x["value"]), CONTACT_CAPS[kind])

    def linked(kind: str) -> Column:
        return F.transform(of(kind), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("url")))

    values = {k: F.transform(of(k), lambda x: x["value"]) for k in keys}
    return {
        "extracted_emails": _cell(values["email"]),
        "extracted_phone_numbers": _cell(values["phone"]),
        "extracted_social_links": _cell(linked("social")),
        "extracted_addresses": _cell(values["address"]),
        "extracted_contact_links": _cell(linked("link")),
    }


def _offering_list(key: Column) -> Column:
    low = F.lower(key)
    return F.when(low.contains("product") & ~low.contains("service"), "products").when(low.contains("service"), "services").otherwise("combined")


def offering_tokens(found: Column) -> Column:
    """Array of (list, value) of all offerings, in order; of an object with a name only the name."""
    listed = {"business": ("products", "services", "offerings")}

    def of(items: Column, to: Column | str) -> Column:
        shown = F.filter(items, lambda x: ~x["hidden"])
        return F.transform(shown, lambda x: F.struct((F.lit(to) if isinstance(to, str) else to).alias("list"), F.substring(_squeezed(x["text"]), 1, LONGEST_OFFERING).alias("value")))

    def at_root(name: str) -> Column:
        own = F.filter(found, lambda x: (x["kind"] == "string") & F.coalesce(F.get(x["path"], F.lit(0)).rlike(OFFERING_KEY), F.lit(False)) & (_offering_list(F.get(x["path"], F.lit(0))) == name))
        return of(F.transform(own, lambda x: F.struct(x["text"].alias("text"), (x["named"] >= 1).alias("hidden"))), name)

    def below(root: tuple[str, ...]) -> list[Column]:
        keys = listed.get(root[0], ("products", "services"))
        return [of(under(found, (*root, k)), "combined" if k == "offerings" else k) for k in keys]

    parts = [*below(OFFERING_ROOTS[0]), *(at_root(name) for name in OFFERING_CAPS), *(c for root in OFFERING_ROOTS[1:] for c in below(root))]
    return F.filter(F.concat(*parts), lambda x: x["value"] != "")


def offering_cells(tokens: Column) -> dict[str, Column]:
    """The offering columns of a row from offering_tokens; the combined list names its own first, then products, then services."""

    def of(name: str) -> Column:
        return F.filter(tokens, lambda x: x["list"] == name)

    def values(items: Column, most: int) -> Column:
        return F.transform(first_by(items, lambda x: F.lower(x["value"]), most), lambda x: x["value"])

    every = F.concat(*(of(name) for name in ("combined", "products", "services")))
    return {
        "extracted_products": _cell(values(of("products"), OFFERING_CAPS["products"])),
        "extracted_services": _cell(values(of("services"), OFFERING_CAPS["services"])),
        "extracted_products_services": _cell(values(every, OFFERING_CAPS["combined"])),
    }


def _is_skipped(keys: Column) -> Column:
    """Whether a way leads through a logo or an address."""
    return F.exists(F.filter(keys, lambda k: k.isNotNull()), lambda k: (F.lower(k) == "url") | F.lower(k).contains("logo"))


def color_tokens(found: Column) -> Column:
    """Texts that may be colours, in order, distinct whatever the case; a telling key stands before its text."""

    def token(x: Column) -> Column:
        key = F.try_element_at(x["keys"], F.lit(-1))
        return trim(F.when(F.coalesce(key.rlike(COLOR_LABEL), F.lit(False)), F.concat(key, F.lit(" "), x["text"])).otherwise(x["text"]))

    texts = F.concat(*(F.transform(F.filter(under(found, root), lambda x: ~_is_skipped(x["keys"])), token) for root in COLOR_ROOTS))
    return first_by(F.filter(texts, lambda t: t != ""), F.lower)


def color_cells(tokens: Column) -> dict[str, Column]:
    """Hex codes, primary and secondary colour from tokens: named ones first, else the first and second."""
    coded = F.filter(F.transform(tokens, lambda t: F.struct(F.lower(t).alias("t"), color.hex_code(t).alias("hex"))), lambda x: x["hex"].isNotNull())

    def pick(v: Column) -> Column:
        hexes = F.array_distinct(F.transform(v, lambda x: x["hex"]))
        at_first = F.array_position(F.transform(v, lambda x: x["t"].contains("primary")), True)
        first = F.get(F.transform(v, lambda x: x["hex"]), (at_first - 1).cast("int"))
        seconds = F.filter(v, lambda x, i: x["t"].rlike(SECOND_COLOR) & (i != at_first - 1))
        return F.struct(
            _cell(F.slice(hexes, 1, MOST_COLORS)).alias("extracted_color_hexes"),
            F.coalesce(first, F.get(hexes, F.lit(0)), F.lit("")).alias("primary_color_hex"),
            F.coalesce(F.get(seconds, F.lit(0))["hex"], F.get(hexes, F.lit(1)), F.lit("")).alias("secondary_color_hex"),
        )

    chosen = let(coded, pick)
    return {c: chosen[c] for c in ("extracted_color_hexes", "primary_color_hex", "secondary_color_hex")}


def color_paths(found: Column) -> Column:
    """Which of the known places hold a colour: array of (path, present)."""
    return F.array(*(F.struct(F.lit(p).alias("path"), F.exists(under(found, tuple(p.split("."))), lambda x: is_filled(x["text"]) & ~_is_skipped(x["keys"])).alias("present")) for p in COLOR_PATHS))


def _from_owners(texts: Column, keys: list[str]) -> Column:
    ways = F.array(*(F.lit(_STEP.join((*owner, key))) for owner in PALETTE_OWNERS for key in keys))
    return F.get(F.filter(F.transform(ways, lambda w: trim(F.try_element_at(texts, w))), lambda t: t != ""), F.lit(0))


def palette_meta(found: Column, texts: Column) -> Column:
    """struct(source, confidence: as the record gives them, null if it does not; from_logo: whether a logo is the colours' origin).

    texts: members(found).
    """
    warned = F.exists(under(found, ("metadata", "warnings")), lambda x: (F.size(x["keys"]) == 1) & F.get(x["keys"], F.lit(0)).isNull() & x["text"].rlike(LOGO_WARNING))
    raw = F.struct(_from_owners(texts, SOURCE_KEYS).alias("source"), _from_owners(texts, CONFIDENCE_KEYS).alias("confidence"), warned.alias("warned"))

    def tidy(v: Column) -> Column:
        source = F.when(v["source"].isNotNull(), color.palette_source(v["source"]))
        confidence = F.when(v["confidence"].isNotNull(), color.palette_confidence(v["confidence"]))
        return F.struct(source.alias("source"), confidence.alias("confidence"), (v["warned"] | F.coalesce(source == "logo", F.lit(False))).alias("from_logo"))

    return let(raw, tidy)


def palette_cells(meta: Column, has_colors: Column) -> dict[str, Column]:
    """Given source and confidence, else what the colours' origin implies; meta: palette_meta."""
    implied = meta["source"].isNull() & has_colors
    return {
        "palette_source": F.when(implied, F.when(meta["from_logo"], "logo").otherwise("extraction")).otherwise(F.coalesce(meta["source"], F.lit(""))),
        "palette_confidence": F.coalesce(meta["confidence"], F.when(implied, F.when(meta["from_logo"], "medium").otherwise("unknown")), F.lit("")),
    }


def palette_category(tokens: Column, from_logo: Column) -> Column:
    """no_colors, logo_fallback or explicit_extraction."""
    return F.when(~F.exists(tokens, lambda t: color.hex_code(t).isNotNull()), "no_colors").when(from_logo, "logo_fallback").otherwise("explicit_extraction")


def logo_cells(logos: Column) -> dict[str, Column]:
    """The logo columns from an array of (url, source, logoRole): count, first address, up to five as JSON."""
    first = F.filter(F.transform(F.slice(logos, 1, MOST_LOGOS), lambda x: F.struct(trim(x["url"]).alias("url"), x["source"].alias("source"), x["logoRole"].alias("logoRole"))), lambda x: x["url"] != "")
    have = F.coalesce(F.size(logos), F.lit(0)) > 0
    return {
        "logo_candidate_count": F.when(have, F.size(logos).cast("string")).otherwise(""),
        "selected_logo_url": F.when(have, F.coalesce(F.get(first, F.lit(0))["url"], F.lit(""))).otherwise(""),
        "logo_candidate_urls": F.when(have, _cell(first)).otherwise(""),
    }


INPUT = ["ds_number", "ds_id", "project_title", "project_type", "shop_code", "normalized_url", "domain", "canonical_domain", "source_column", "first_req_description", "first_req_note"]
_HEAD = f"struct<input: struct<{', '.join(f'{c}: string' for c in INPUT)}>, status: string, elapsed_ms: string, error_message: string>"
_LOGOS = "array<struct<url: string, source: string, logoRole: string>>"


def review_rows(records: DataFrame, record_col: str = "record") -> DataFrame:
    """A review row for each record that is JSON, beside the other columns of records.

    A record holds input (the request), status, elapsed_ms, error_message and
    expo_output (what was extracted, without a fixed schema; null leaves its cells
    blank). A row whose record is null or no JSON is left out (see bad_records).
    Columns of records with names of the new ones are replaced.
    """
    r = F.col(record_col)
    kept = [c for c in records.columns if c != record_col]
    read = records.withColumns({"_head": F.from_json(r, _HEAD), "_logos": F.from_json(F.get_json_object(r, "$.expo_output.brand.logoCandidates"), _LOGOS), "_all": leaves(r)}).filter("_all IS NOT NULL")
    expo = F.transform(F.filter("_all", lambda x: F.coalesce(F.get(x["path"], F.lit(0)) == "expo_output", F.lit(False))), lambda x: x.withField("path", F.slice(x["path"], F.lit(2), F.greatest(F.size(x["path"]) - 1, F.lit(0)))).withField("named", x["named"] - 1))
    read = read.withColumn("_expo", expo).drop("_all", record_col).withColumns({"_texts": members(F.col("_expo")), "_numbers": members(F.col("_expo"), "number")})
    e, texts = F.col("_expo"), F.col("_texts")
    tokens = read.withColumns({"_contact": contact_tokens(e, texts), "_offers": offering_tokens(e), "_colors": color_tokens(e), "_meta": palette_meta(e, texts)})
    cells = tokens.withColumns(color_cells(F.col("_colors")))
    has_colors = any_of(*(is_filled(F.col(c)) for c in ("extracted_color_hexes", "primary_color_hex", "secondary_color_hex")))
    cells = cells.withColumns(palette_cells(F.col("_meta"), has_colors))
    of_logo = (F.col("palette_source") == "logo") & is_filled(F.col("extracted_color_hexes"))
    cells = cells.withColumn("_refined", color.refine_palette(F.when(of_logo, color.hex_list(F.col("extracted_color_hexes")))))
    refined = {c: F.when(of_logo, v).otherwise(F.col(c)) for c, v in color_cells(F.col("_refined.colors")).items()}
    counts = {
        f"palette_{kind}_color_count": F.coalesce(*(member(F.col("_numbers"), o, f"palette{kind.title()}ColorCount").cast("long") for o in ("brand", "metadata")), F.when(of_logo, F.col(f"_refined.{kind}_count").cast("long")))
        for kind in ("raw", "distinct")
    }
    at = lambda *keys: trim(member(texts, *keys))
    given = {c: trim(F.col(f"_head.input.{c}")) if c in ("domain", "project_title") else F.coalesce(F.col(f"_head.input.{c}"), F.lit("")) for c in INPUT}
    name, headline = at("business", "name"), at("designIntake", "recommendedHeadline")
    listed = F.concat(*(F.transform(F.filter(under(e, ("content", k)), lambda x: (F.size(x["keys"]) == 1) & F.get(x["keys"], F.lit(0)).isNull() & (x["text"] != "")), lambda x: x["text"]) for k in ("services", "products")))
    new = {
        **{c: given[c] for c in INPUT if c not in ("canonical_domain", "first_req_description", "first_req_note")},
        "canonical_domain": F.coalesce(filled(F.col("_head.input.canonical_domain")), U.canonical_domain(given["domain"])),
        "first_req_description_excerpt": text.excerpt(given["first_req_description"]),
        "first_req_note_excerpt": text.excerpt(given["first_req_note"]),
        **{c: F.coalesce(F.col(f"_head.{c}"), F.lit("")) for c in ("status", "elapsed_ms", "error_message")},
        "extracted_business_name": name,
        "extracted_business_category": at("designIntake", "productCategory"),
        "extracted_tagline": F.when((headline != "") & (F.lower(headline) != F.lower(name)), headline).otherwise(""),
        "extracted_summary": F.coalesce(filled(member(texts, "designIntake", "recommendedSupportingText")), F.array_join(F.slice(listed, 1, MOST_SUMMARY), "; ")),
        **contact_cells(F.col("_contact")),
        **offering_cells(F.col("_offers")),
        **logo_cells(F.col("_logos")),
        **refined,
        "palette_source": F.col("palette_source"),
        "palette_confidence": F.col("palette_confidence"),
        **{c: F.when(v > 0, v.cast("string")).otherwise("") for c, v in counts.items()},
        "pages_inspected": F.coalesce(member(F.col("_numbers"), "metadata", "pagesInspected"), F.lit("")),
        "extraction_provider": at("metadata", "source"),
        "extraction_model": at("metadata", "claude", "model"),
        "business_name_similarity_hint": text.overlap_hint(given["project_title"], name),
        "title_business_name_overlap_hint": text.title_overlap_hint(given["project_title"], name),
        "palette_category": palette_category(F.col("_colors"), F.col("_meta.from_logo")),
        "color_paths": F.array_join(F.transform(F.filter(color_paths(e), lambda x: x["present"]), lambda x: x["path"]), ","),
    }
    return cells.select(*(F.col(c) for c in kept if c not in new), *(v.alias(c) for c, v in new.items()))


def bad_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """The rows of records whose record is null or no JSON."""
    return records.withColumn("_all", leaves(F.col(record_col))).filter("_all IS NULL").drop("_all")
