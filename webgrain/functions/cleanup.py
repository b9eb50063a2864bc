"""Cleaning of extracted values, and the name of a business from its page titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgrain.functions.base import distinct_by, let, trim
from webgrain.functions.text import name_from_domain

# The formats ask for these characters, words and bounds.
NOISE = r"\s,;:·•|.\-"
NOISE_CHARS = " \t\n\x0b\f\r,;:·•|.-"
PUNCTUATION = r"[(){}\[\].,;:!?\-_|/\\·•]"
SHORT_WORDS = ["ai", "ar", "vr", "tv", "uk", "us", "eu", "qr", "co", "id", "it", "hr", "pr", "ux", "ui", "3d", "2d", "4k", "8k", "5g", "4g"]
NAVIGATION = r"(?i)^(home|menu|sign[-_ ]?in|sign[-_ ]?up|log[-_ ]?in|log[-_ ]?out|cart|account|search)$"
GENERIC_TITLE = r"(?i)^(home|homepage|welcome|official\s+site|index|untitled)$"
LIST_ITEMS, FIELD_ITEMS, ITEM_CHARS, NAME_CHARS = 8, 6, 64, 200


def squeeze(c: Column) -> Column:
    """White space runs, no-break spaces included, as one space; none at the ends; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\s\x{A0}]{2,}+|[\s\x{A0}&&[^ ]]", " "))


def without_noise(c: Column) -> Column:
    """Without empty brackets, doubled separators and separators at the ends or inside a bracket's ends."""
    # The order of these replacements is part of the format. Each tries a run from its first character only,
    # so a long run of separators costs its length.
    steps = [
        (rf"\([{NOISE}]*+\)|\[[{NOISE}]*+\]", " "),
        (r"[,;]+\s*[,;]+", ", "),
        (r"\.{2,}", "."),
        (rf"\([{NOISE}]++(?=[^()]*+\))", "("),
        (rf"\(([^()]*[^(){NOISE}])[{NOISE}]++\)", "($1)"),
        (r"\(\)", " "),
        (r"(?<!\s)\s++([,;:.!?])", "$1"),
        (r"([,;])\1++", "$1"),
    ]
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return squeeze(F.rtrim(F.ltrim(c, F.lit(NOISE_CHARS.replace("-", ""))), F.lit(NOISE_CHARS)))


#: What without_noise changes, or what stands at the ends, matches this.
MAY_CHANGE = rf"[()\[\]\t\n\x0B\f\r\x{{A0}}]|  |\.\.|[ ,;][,;:.!?]|^[{NOISE}]|[{NOISE}]$"


def _tidy_part(part: Column) -> Column:
    """A list's part without noise, at its ends either; most parts have none and stay as they are."""
    bare = F.trim(F.regexp_replace(without_noise(part), rf"^[{NOISE}]+|[{NOISE}]+$", ""))
    return F.when(part.rlike(MAY_CHANGE), bare).otherwise(part)


def _count(c: Column, characters: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(c) - F.length(F.regexp_replace(c, rf"{characters}++", ""))


def is_meaningful(item: Column) -> Column:
    """Whether a list item says something: words or a size, not punctuation, repeats of one letter or navigation."""

    def check(t: Column) -> Column:
        counts = F.struct(_count(t, "[A-Za-z]").alias("letters"), _count(t, "[0-9]").alias("digits"), _count(t, PUNCTUATION).alias("marks"))
        short = (F.length(t) < 3) & F.lower(t).isin(*SHORT_WORDS)
        long_enough = F.length(t).between(3, ITEM_CHARS) & t.rlike(r"[A-Za-z]{3,}|(?i)\b\d+\s*[x×]\s*\d+\b") & ~t.rlike(NAVIGATION)
        return (short | long_enough) & let(counts, lambda n: sound(t, n))

    def sound(t: Column, n: Column) -> Column:
        letters, others = n["letters"], n["letters"] + n["digits"]
        most = let(F.lower(t), lambda x: F.length(x) - F.least(*(F.length(F.replace(x, F.lit(chr(k)), F.lit(""))) for k in range(ord("a"), ord("z") + 1))))
        repeats = (F.length(t) >= 3) & (letters >= 6) & (most > 0.7 * letters)
        return (others > 0) & ((n["marks"] == 0) | (n["marks"] < others)) & ~repeats

    return let(trim(item), check)


def _listed(bare: Column, most: int) -> Column:
    """clean_list of a text without noise. Parts are looked at in order, until nothing can change any more."""

    def add(seen: Column, part: Column) -> Column:
        def with_item(item: Column) -> Column:
            known = F.exists(seen["kept"], lambda k: F.lower(k) == F.lower(item))
            stays = (F.size(seen["kept"]) >= most) | known | ~is_meaningful(item)
            kept = F.when(stays, seen["kept"]).otherwise(F.array_append(seen["kept"], item))
            return F.when(item == "", seen).otherwise(F.struct(kept.alias("kept"), (seen["parts"] + 1).alias("parts")))

        done = (F.size(seen["kept"]) >= most) & ((seen["parts"] >= 5) | (F.size(seen["kept"]) > 1))
        return F.when(done, seen).otherwise(let(_tidy_part(part), with_item))

    def joined(seen: Column) -> Column:
        return F.when((seen["parts"] >= 5) & (F.size(seen["kept"]) == 1), "").otherwise(F.array_join(seen["kept"], ", "))

    nothing = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("parts"))
    return F.aggregate(F.split(bare, r"\s*[,;·•|]\s*"), nothing, add, joined)


def clean_list(c: Column, most: int = LIST_ITEMS) -> Column:
    """The meaningful items of a list in prose, distinct whatever the case; '' if one of five or more is left."""
    return let(without_noise(squeeze(c)), lambda bare: _listed(bare, most))


def _prose(bare: Column) -> Column:
    letters = _count(bare, "[A-Za-z]")
    return F.when((letters >= 3) & (_count(bare, PUNCTUATION) <= 1.2 * letters), bare).otherwise("")


def clean_text(c: Column) -> Column:
    """Free text without noise; '' if it has under three letters or is mostly punctuation."""
    return let(without_noise(squeeze(c)), _prose)


def clean_phone(c: Column) -> Column:
    """Digits and what may stand between them; '' if there are under seven."""
    kept = squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0123456789+()\- \t\n\x0B\f\r.,/extEXT]++", ""))
    return let(kept, lambda t: F.when(_count(t, r"\d") >= 7, t).otherwise(""))


def clean_email(c: Column) -> Column:
    """The first address, or ''."""
    # A match begins where its run of characters does, so a long run without an @ costs its length.
    return F.when(F.contains(c, F.lit("@")), F.regexp_extract(c, r"(?<![\w.+\-])[\w.+\-]++@[\w\-]+\.[\w.\-]+", 0)).otherwise("")


_LISTS, _TEXTS, _OWN = ("services", "products"), ("social", "address", "logo"), {"phone": clean_phone, "email": clean_email}


def clean_fields(fields: list[str], c: Column) -> Column:
    """struct of a value as cleaned for each of the named fields; what they share is done once."""

    def one(field: str, raw: Column, bare: Column) -> Column:
        if field in _LISTS:
            return _listed(bare, FIELD_ITEMS)
        if field in _TEXTS:
            return _prose(bare)
        return {"brandColors": bare}[field] if field not in _OWN else _OWN[field](raw)

    def every(raw: Column) -> Column:
        bare = F.lit("") if set(fields) <= set(_OWN) else without_noise(squeeze(raw))
        return let(bare, lambda b: F.struct(*(one(f, raw, b).alias(f) for f in fields)))

    return let(c, every)


def clean_field(field: str, c: Column) -> Column:
    """A value of the named field, cleaned as that field asks."""
    return clean_fields([field], c)[field]


def domain_label(host: Column) -> Column:
    return F.regexp_extract(trim(F.regexp_replace(trim(host), r"(?i)^www\.", "")), r"^([^.]*)", 1)


def is_brand_like(segment: Column, label: Column) -> Column:
    """Whether a part of a title reads like a name: like the domain's label, or one capitalised word."""
    bare, name = F.regexp_replace(F.lower(segment), r"\s+", ""), F.lower(label)
    bad = (
        ~F.length(segment).between(2, 80)
        | segment.rlike(GENERIC_TITLE)
        | (F.size(F.split(segment, r"\s+")) > 6)
        | (segment.rlike(r"(?i)^(the|a|an)\s+") & (F.length(segment) > 48))
    )
    of_domain = (name != "") & (bare.contains(name) | name.contains(bare))
    return ~bad & (of_domain | segment.rlike(r"[A-Z][a-z]+[A-Z]|^[A-Z][a-zA-Z0-9&.'-]{1,40}$"))


def brand_segments(title: Column, label: Column, once: bool = True) -> Column:
    """The parts of a title that read like a name; with once, of parts that differ in case only the first is looked at."""
    parts = F.filter(F.transform(F.split(trim(title), r"\s*[|\-–—:]\s*"), trim), lambda p: p != "")
    if once:
        parts = let(parts, lambda items: distinct_by(items, F.lower))
    return F.filter(parts, lambda p: is_brand_like(p, label))


#: Fixed value: the name that stands in a form that nobody has filled in.
PLACEHOLDER = "Example Brand Co."


def usable_suggestion(suggested: Column, intake: Column) -> Column:
    """A suggested name, '' where it only repeats the form's placeholder or the name that the form was left with."""
    name, given = trim(suggested), trim(intake)
    echoed = (given.isin("", PLACEHOLDER)) & ((name == PLACEHOLDER) | ((given != "") & (F.lower(name) == F.lower(given))))
    return F.when(echoed, "").otherwise(name)


def resolved_name(suggested: Column, intake: Column, og_title: Column, title: Column, host: Column, once: bool = True) -> Column:
    """struct(name, source: claude, title, domain or none; inferred_from_domain) from a suggestion that is usable, the titles, the host; once as in brand_segments."""

    def label(b: Column) -> Column:
        source = F.when(b["source"] == "suggested", "claude").otherwise(b["source"])
        return F.struct(b["name"].alias("name"), source.alias("source"), (b["source"] == "domain").alias("inferred_from_domain"))

    return let(business_name(usable_suggestion(suggested, intake), og_title, title, host, once), label)


def business_name(suggested: Column, og_title: Column, title: Column, host: Column, once: bool = True) -> Column:
    """struct(name, source): what was suggested, else the longest brand-like title part, else the domain's label; once as in brand_segments."""
    label = domain_label(host)
    parts = F.concat(brand_segments(og_title, label, once), brand_segments(title, label, once))
    longest = F.aggregate(parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    named = F.array(
        *(
            F.struct(F.substring(c, 1, NAME_CHARS).alias("name"), F.lit(kind).alias("source"))
            for c, kind in ((trim(suggested), "suggested"), (longest, "title"), (name_from_domain(host), "domain"))
        )
    )
    found = F.get(F.filter(named, lambda n: n["name"] != ""), F.lit(0))
    return F.coalesce(found, F.struct(F.lit("").alias("name"), F.lit("none").alias("source")))
