"""Cleaning in linear time, repeated score cells, quality levels, styles, names and united sources."""

import time

import pytest
from pyspark.sql import functions as F

from webgrain.functions import cleanup, text
from webgrain.operators import inventory, pages
from webgrain.sources import typed


@pytest.mark.parametrize("cell", ["(" + "-" * 20_000, "a" + "-" * 20_000 + "b", "(" * 20_000, "x " + " " * 20_000 + "y", "(" + " , - " * 5_000 + "z", ",;" * 10_000 + "w", "(-a-" * 5_000])
def test_noise_in_linear_time(spark, cell):
    df = spark.createDataFrame([(cell,)], "x string").select(cleanup.without_noise(F.col("x")))
    df.collect()
    began = time.time()
    df.collect()
    assert time.time() - began < 1


def test_noise(spark):
    cells = {"(- big -) x": "(big) x", "( , ) a": "a", "a (b, c; ) d , e": "a (b, c) d, e", "( - (a) - )": "( - (a) - )", "x ;; y": "x, y", "(--": "(", ", --": "", "a - b -": "a - b", "": ""}
    df = spark.createDataFrame([(k,) for k in cells], "x string").select("x", cleanup.without_noise(F.col("x")).alias("y"))
    assert {r["x"]: r["y"] for r in df.collect()} == cells


def test_score_summary_takes_the_last_of_equal_keys(spark):
    rows = [("average", "a", "1"), ("average", "a", "2.5"), ("status", "ok", "3"), ("status", "ok", "4"), ("meta", "total_rows", "7"), ("meta", "total_rows", "9")]
    r = typed.read_score_summary(spark.createDataFrame(rows, "section string, key string, value string").coalesce(1)).first()
    assert r["averages"] == {"a": "2.5"} and r["status_counts"] == {"ok": 4} and r["total_rows"] == 9


LOGOS = "array<struct<url: string, source: string, logoRole: string>>"


@pytest.mark.parametrize(
    ("name", "source", "logos", "n", "blocked", "want"),
    [
        ("A", "claude", [("l", "img-logo", None)], (2, 0), False, ("high", "high", "high", "high")),
        ("A", "title", [("l", "x", "icon_mark")], (1, 0), False, ("medium", "medium", "medium", "medium")),
        ("A", "domain", [("l", "x", "wordmark")], (1, 1), False, ("low", "high", "high", "low")),
        ("A", "claude", [("https://a/favicon.ico", "icon", None)], (0, 0), False, ("high", "low", "low", "low")),
        ("A", "claude", [("https://a/logo.svg", "icon", None)], (2, 2), False, ("high", "medium", "high", "medium")),
        ("A", "claude", [("x", "og:image", "social_preview"), ("y", "x", "unknown")], (2, 2), False, ("high", "low", "high", "low")),
        ("A", "claude", [("l", "img-logo", None)], (2, 0), True, ("high", "high", "high", "high")),
        (" ", "claude", [], (0, 0), True, ("low", "low", "low", "low")),
    ],
)
def test_quality(spark, name, source, logos, n, blocked, want):
    df = spark.createDataFrame([(name, source, logos, *n, blocked)], f"name string, source string, logos {LOGOS}, s int, p int, blocked boolean")
    levels = pages.quality_levels(*map(F.col, ("name", "source", "logos", "s", "p", "blocked")), F.lit("success"))
    assert tuple(df.select(levels.alias("q")).first()["q"]) == want


def test_style(spark):
    cases = {"Georgia": "classic_serif", "Georgia,Inter": "modern_sans", "Fira Code": "technical", "Comic Sans": "playful", "": "unknown", "Nothing": "unknown", "Montserrat": "modern_sans"}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", pages.style_guess(F.split("x", ",")).alias("y"))
    assert {r["x"]: r["y"] for r in df.collect()} == cases


def test_sources_of_collapsed_rows(spark):
    rows = [(0, "a; b", 2), (1, "c", 1), (2, "d; a", 3), (3, "b;e", 1)]
    review = "struct<status: string, processed_at: string, extraction_run_id: string, source_review_queue: string, domain: string, normalized_url: string>"
    df = spark.createDataFrame([(k, s, "x.org", "x.org", "https://x.org", "", "success", ("success", f"2024-01-0{t}", "", "", "x.org", "")) for k, s, t in rows], f"original_index long, source_column string, canonical_domain string, domain string, normalized_url string, raw_url string, extraction_status string, review {review}")
    (row,) = inventory.collapse_inventory(df).collect()
    assert row["source_column"] == "d; a; b; c; e" and row["hidden_variants"] == 3 and row["original_index"] == 0


def test_json_cells(spark):
    cells = {"12 Long Street": ["12 Long Street"], '["a", " "]': ["a"], "7": [], '{"a":1}': [], '["a"] x': ['["a"] x'], "a; b": ["a", "b"], "": [], "true": []}
    df = spark.createDataFrame([(k,) for k in cells], "x string").select("x", text.json_strings(F.col("x")).alias("y"))
    assert {r["x"]: r["y"] for r in df.collect()} == cells
