"""Colours: hex codes, CIE L*a*b*, contrast, palettes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgrain.functions.base import trim
from webgrain.functions.text import is_json, json_strings


def hex_code(c: Column) -> Column:
    """The first #rgb to #rrggbbaa in a text (three digits are doubled), or six bare digits; lower case, else null."""
    t = trim(c)
    found = F.lower(F.regexp_extract(t, r"#([0-9A-Fa-f]{3,8})(?![0-9A-Za-z_])", 1))
    doubled = F.regexp_replace(found, "(.)", "$1$1")
    return (
        F.when(F.length(found) == 3, F.concat(F.lit("#"), doubled))
        .when(found != "", F.concat(F.lit("#"), found))
        .when(t.rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.lower(t)))
    )


def hex_list(c: Column) -> Column:
    """Hex codes of a JSON list (items that are no code stay as they are) or of a delimited list (they go)."""
    t = trim(c)
    listed = F.transform(json_strings(c), lambda x: F.coalesce(hex_code(x), x))
    parts = F.filter(F.transform(F.split(t, r"[;,|·]"), hex_code), lambda x: x.isNotNull())
    return F.when(is_json(t), listed).otherwise(parts)


def hex_codes_in_text(c: Column) -> Column:
    """All #rgb and #rrggbb, six digits each."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"#(?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})(?![0-9A-Fa-f])"), F.lit(0))
    return F.transform(found, hex_code)


def channels(hex6: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue, 0 to 255, of #rrggbb."""
    return tuple(F.conv(F.substring(hex6, at, 2), 16, 10).cast("int") for at in (2, 4, 6))


def _linear(v: Column) -> Column:
    x = v / 255.0
    return F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, 2.4)).otherwise(x / 12.92)


def lab(hex6: Column) -> Column:
    """struct(l, a, b) of an sRGB colour under D65."""
    r, g, b = (_linear(v) for v in channels(hex6))
    x = (r * 0.4124 + g * 0.3576 + b * 0.1805) / 0.95047
    y = r * 0.2126 + g * 0.7152 + b * 0.0722
    z = (r * 0.0193 + g * 0.1192 + b * 0.9505) / 1.08883
    f = lambda t: F.when(t > 0.008856, F.pow(t, 1 / 3)).otherwise(7.787 * t + 16 / 116)
    return F.struct((116 * f(y) - 16).alias("l"), (500 * (f(x) - f(y))).alias("a"), (200 * (f(y) - f(z))).alias("b"))


def delta_e(a: Column, b: Column) -> Column:
    """Distance of two lab structs."""
    return F.sqrt(F.pow(a["l"] - b["l"], 2) + F.pow(a["a"] - b["a"], 2) + F.pow(a["b"] - b["b"], 2))


def neutral_kind(hex6: Column) -> Column:
    """dark, light, gray, or null for a colour that is none."""
    rgb = [v / 255.0 for v in channels(hex6)]
    high, low = F.greatest(*rgb), F.least(*rgb)
    light = (high + low) / 2
    sat = F.when(high == low, 0.0).when(light > 0.5, (high - low) / (2 - high - low)).otherwise((high - low) / (high + low))
    return F.when(light < 0.08, "dark").when((light > 0.92) & (sat < 0.12), "light").when((sat < 0.15) & (light > 0.12) & (light < 0.88), "gray")


def luminance(hex6: Column) -> Column:
    r, g, b = (_linear(v) for v in channels(hex6))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast_ratio(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def palette_source(c: Column) -> Column:
    t = F.lower(trim(c))
    return (
        F.when(t.isin("logo", "logo_fallback", "logo-fallback"), "logo")
        .when(t.isin("extraction", "explicit", "extracted", "explicit_extraction"), "extraction")
        .otherwise(trim(c))
    )


def palette_confidence(c: Column) -> Column:
    t = F.lower(trim(c))
    return F.when(t.isin("high", "medium", "low", "unknown"), t).otherwise(trim(c))


def _rgb(hex6: str) -> tuple[int, int, int]:
    return tuple(int(hex6[i : i + 2], 16) for i in (1, 3, 5))


def _lab(hex6: str) -> tuple[float, float, float]:
    r, g, b = (((v + 0.055) / 1.055) ** 2.4 if v > 0.04045 else v / 12.92 for v in (c / 255 for c in _rgb(hex6)))
    x, y, z = (r * 0.4124 + g * 0.3576 + b * 0.1805) / 0.95047, r * 0.2126 + g * 0.7152 + b * 0.0722, (r * 0.0193 + g * 0.1192 + b * 0.9505) / 1.08883
    fx, fy, fz = (t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116 for t in (x, y, z))
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def _neutral(hex6: str) -> str | None:
    rgb = [c / 255 for c in _rgb(hex6)]
    high, low = max(rgb), min(rgb)
    light = (high + low) / 2
    sat = 0.0 if high == low else (high - low) / ((2 - high - low) if light > 0.5 else (high + low))
    if light < 0.08:
        return "dark"
    if light > 0.92 and sat < 0.12:
        return "light"
    return "gray" if sat < 0.15 and 0.12 < light < 0.88 else None


def _clusters(hexes: list[str], near: float) -> list[tuple[str, int]]:
    """Seeds by falling weight take what lies near; (dominant colour, summed weight) by falling weight."""
    weight: dict[str, int] = {}
    for i, h in enumerate(hexes):
        if len(h or "") == 7:
            weight[h] = weight.get(h, 0) + len(hexes) - i
    left, out = sorted(weight, key=lambda h: -weight[h]), []
    while left:
        seed = _lab(left[0])
        group = [h for h in left if math.dist(seed, _lab(h)) <= near]
        out.append((group[0], sum(weight[h] for h in group)))
        left = [h for h in left if h not in group]
    return sorted(out, key=lambda c: -c[1])


_REFINED = T.StructType(
    [T.StructField("colors", T.ArrayType(T.StringType())), T.StructField("raw_count", T.IntegerType()), T.StructField("distinct_count", T.IntegerType())]
)


@F.pandas_udf(_REFINED)
def refine_palette(palettes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Of each list of hex codes, the most important first, a palette of four colours at most.

    Colours within a distance of 12 are one. Up to three accents come first, then
    the heaviest dark and light; a gray only where there is no accent. The
    clustering depends on order, hence a pandas UDF on short lists.
    """
    for series in palettes:
        rows = []
        for hexes in series:
            raw = list(hexes) if hexes is not None else []
            merged = _clusters(raw, 12.0)
            kinds = [_neutral(h) for h, _ in merged]
            first = lambda kind: [h for (h, _), k in zip(merged, kinds, strict=True) if k == kind][:1]  # noqa: B023, E731
            accents = [h for (h, _), k in zip(merged, kinds, strict=True) if k is None]
            picked = accents[:3] + first("dark") + first("light")
            if not accents:
                picked += first("gray")
            rows.append((picked[:4] or [h for h, _ in merged[:1]], len({h for h in raw if len(h or "") == 7}), len(merged)))
        yield pd.DataFrame(rows, columns=["colors", "raw_count", "distinct_count"])
