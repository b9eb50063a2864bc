"""Expressions that the other modules share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of the trimming that the formats ask for.
SPACE = r"[\s ﻿]"


def trim(c: Column) -> Column:
    """Without white space at both ends, no-break spaces included; null is ''."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")


def filled(c: Column) -> Column:
    """The trimmed text, or null if nothing is left."""
    t = trim(c)
    return F.when(t != "", t)


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*(filled(c) for c in cs))


def is_filled(c: Column) -> Column:
    return trim(c) != ""


def one_of(c: Column, *values: str) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def any_of(*cs: Column) -> Column:
    return reduce(lambda a, b: a | b, cs)


def all_of(*cs: Column) -> Column:
    return reduce(lambda a, b: a & b, cs)


def count_true(*cs: Column) -> Column:
    """How many of the conditions hold in a row."""
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(False)).cast("int") for c in cs))


def distinct_by(items: Column, key) -> Column:
    """Items in order, the first of each key (key: Column -> Column)."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, key), key(x)) == i + 1)


def first_by(items: Column, key, most: int | None = None) -> Column:
    """The first item of each key, in order, up to so many; in time by items and kept ones, for lists of any length."""

    def pick(v: Column) -> Column:
        keys = F.array_distinct(v["keys"])
        kept = keys if most is None else F.slice(keys, 1, most)
        return F.transform(kept, lambda k: F.get(v["items"], (F.array_position(v["keys"], k) - 1).cast("int")))

    return let(F.struct(items.alias("items"), F.transform(items, key).alias("keys")), pick)


def distinct_ignoring_case(items: Column) -> Column:
    return distinct_by(items, F.lower)


def distinct_capped(items: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))), 1, most)


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(F.lit(100.0) * part / whole + 0.5)).otherwise(F.lit(0)).cast("long")


def let(value: Column, use) -> Column:
    """use(value) with value computed once; keeps expressions small where use names it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
