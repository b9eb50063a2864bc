"""Roles, points and what is shown of logo candidates; warnings."""

import pytest
from pyspark.sql import functions as F

from webgrain.operators import logos, pages

COLUMNS = "site int, place int, url string, source string, alt string, width int, height int, tokens array<string>"


def scored(spark, *rows):
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], COLUMNS)
    return {r["place"]: r for r in logos.score_candidates(df).collect()}


@pytest.mark.parametrize(
    ("row", "role"),
    [
        (("https://a.org/logo.svg", "header-image", "Acme logo", 180, 40, ["acme"]), "wordmark"),
        (("https://a.org/hero-bg.png", "header-image", "Get started", 900, 400, ["acme"]), "marketing_image"),
        (("https://scontent-x.cdninstagram.com/v/1.jpg", "og:image", None, None, None, ["acme"]), "social_preview"),
        (("https://a.org/share.jpg", "og:image", None, 1200, 630, ["acme"]), "social_preview"),
        (("https://a.org/favicon.ico", "icon", None, None, None, []), "fallback_icon"),
        (("https://a.org/x/identity.png", "icon", None, 40, 40, ["acme"]), "wordmark"),
        (("https://a.org/acme.svg", "icon", None, 32, 32, ["acme"]), "icon_mark"),
        (("https://a.org/acme.png", "icon", None, 32, 32, ["acme"]), "fallback_icon"),
        (("https://a.org/picture.png", "header-image", "", 500, 500, []), "unknown"),
        (("not an address", "img-logo", None, None, None, None), "unknown"),
    ],
)
def test_roles(spark, row, role):
    assert scored(spark, row)[0]["logo_role"] == role


def test_points_and_reasons(spark):
    row = scored(spark, ("https://a.org/logo.svg", "header-image", "Acme logo", 180, 40, ["acme"]))[0]
    assert row["reason"] == "header/nav image; brand name in alt/path; alt matches logo keyword; brand logo path; SVG wordmark/logo; wordmark proportions; classified wordmark; header wordmark with brand match; larger logo-like graphic; larger usable dimensions; primary brand mark asset"
    assert row["score"] == 94 + 42 + 18 + 14 + 16 + 18 + 20 + 10 + 12 + 8 + 58 and row["transparency"] == "likely_transparent"


def test_what_is_shown(spark):
    strong, icon, thumb = ("https://a.org/logo.svg", "header-image", "acme logo", 180, 40, ["acme"]), ("https://a.org/favicon.ico", "icon", None, None, None, ["acme"]), ("https://x.fbcdn.net/p/1.jpg", "og:image", None, None, None, ["acme"])
    rows = [(1, 0, *icon), (1, 1, *strong), (1, 2, *thumb), (2, 0, *icon), (2, 1, *thumb), (3, 0, *thumb)] + [(4, k, f"https://a.org/logo{k}.png", "img-logo", "acme logo", 200, 50, ["acme"]) for k in range(9)]
    out = logos.rank_candidates(spark.createDataFrame(rows, COLUMNS))
    got = {}
    for r in out.orderBy("site", "rank").collect():
        got.setdefault(r["site"], []).append(r["place"])
    assert got == {1: [1], 2: [0], 3: [0], 4: [0, 1, 2, 3, 4, 5]}
    sites = {r["site"]: (r["n_strong"], r["best_role"], r["only_icons"]) for r in logos.site_summary(out).collect()}
    assert sites == {1: (1, "wordmark", False), 2: (0, "fallback_icon", True), 3: (0, "social_preview", True), 4: (6, "wordmark", False)}
    assert logos.rank_candidates(spark.createDataFrame([], COLUMNS)).count() == 0


def test_brand_tokens(spark):
    cases = [("https://www.acme-tools.com/x", "Acme Tools | Home", "The Acme"), ("https://ab.org", None, ""), ("https://x.org", "Welcome", None), (None, "a b cd", "")]
    df = spark.createDataFrame(cases, "u string, a string, b string")
    assert [r[0] for r in df.select(logos.brand_tokens(F.col("u"), F.col("a"), F.col("b"))).collect()] == [["acme-tools", "acme", "tools"], ["ab"], [], ["cd"]]


def test_warnings(spark):
    fetch = "struct<status: string, reason: string, blocked: boolean, diagnostics: array<string>>"
    df = spark.createDataFrame([(("partial", "body_truncated", False, ["blocked", "timeout", "odd"]), False, " ", "none", [], 0, 0, False), (("success", None, False, None), True, "A", "domain", [("x/favicon.ico", "icon", None)], 1, 0, False)], f"f {fetch}, a boolean, n string, s string, l array<struct<url: string, source: string, logoRole: string>>, x int, y int, c boolean")
    codes = pages.warning_codes(*map(F.col, "fanslxyc"))
    got = [r[0] for r in df.select(codes).collect()]
    assert got[0] == ["large_site_partial_extraction", "body_truncated", "site_blocked_static_fetch", "timeout", "claude_failed_or_skipped", "missing_business_name", "missing_logo_candidates", "missing_services_products", "low_content_extracted"]
    assert got[1] == ["business_name_inferred_from_domain", "favicon_only_logo_candidate"]
    assert df.select(pages.merged_warnings(F.array(F.lit(" w "), F.lit("timeout"), F.lit("")), codes)).first()[0][:3] == ["w", "timeout", "large_site_partial_extraction"]
