"""Web addresses against what the URL standard gives."""

from pyspark.sql import functions as F

from webgrain.functions import href
from webgrain.functions import url as U

HREFS = {
    "HTTP://Ex.COM": "http://ex.com/",
    "https://ex.com:443/a/../b/./c?x=a b#é \"": "https://ex.com/b/c?x=a%20b#%C3%A9%20%22",
    "https://ex.com/a/b/..": "https://ex.com/a/",
    "https://ex.com/../..": "https://ex.com/",
    "https://ex.com/é ü/%2e%2E/x%": "https://ex.com/x%",
    "http:\\\\ex.com\\a\\b": "http://ex.com/a/b",
    "https://5551234": "https://0.84.180.130/",
    "https://1.2.3": "https://1.2.0.3/",
    "https://1.2.3.256": None,
    "https://a b.com": None,
    "https://ex.com:99999/": None,
    "https://u:p@ex.com:0080/": "https://u:p@ex.com:80/",
    "https://ex.com/😀{}": "https://ex.com/%F0%9F%98%80%7B%7D",
    "https://ex.com/a//../b": "https://ex.com/a/b",
    " \thttps://ex.com/\n ": "https://ex.com/",
    "ftp://ex.com/": None,
    "https://": None,
    "": None,
}
LINKS = {
    "c": "https://ex.com/a/c", "../c": "https://ex.com/c", "/x/../y": "https://ex.com/y", "?z": "https://ex.com/a/b?z", "#g": "https://ex.com/a/b?q=1#g",
    "": "https://ex.com/a/b?q=1", "//h.org/p": "https://h.org/p", "mailto:a@b": None, "HTTPS://z.de": "https://z.de/", "./": "https://ex.com/a/", "..": "https://ex.com/",
    "x y": "https://ex.com/a/x%20y", "javascript:1": None, "\\w": "https://ex.com/w",
}


def ask(spark, cases, use):
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x string").select("x", use(F.col("x")).alias("y"))
    return {r["x"]: r["y"] for r in df.collect()}


def test_href(spark):
    assert ask(spark, HREFS, href.href) == HREFS | {None: None}


def test_resolve(spark):
    assert ask(spark, LINKS, lambda c: href.resolve(c, F.lit("https://Ex.com/a/b?q=1#f"))) == LINKS | {None: None}


def test_safe(spark):
    cases = {"ex.com": "https://ex.com/", "//ex.com/a b": "https://ex.com/a%20b", "javascript:alert(1)": None, "MAILTO:a@b.c": None, "two words": None, "Austin": "https://austin/"}
    assert ask(spark, cases, U.safe_href) == cases | {None: None}


def test_normalised_paths_and_queries(spark):
    cases = {
        "https://ex.com/a/./b/../c/": "https://ex.com/a/c",
        "https://ex.com/é?z=1&b=a b&b=%C3%A9&utm_source=q&a=~+x": "https://ex.com/%C3%A9?a=%7E+x&b=a+b&b=%C3%A9&z=1",
        "https://ex.com/x?a=%zz": "https://ex.com/x?a=%25zz",
        "https://ex.com/..": "https://ex.com",
    }
    assert ask(spark, cases, U.normalize) == cases | {None: None}
