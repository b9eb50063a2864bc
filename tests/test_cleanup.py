"""Cleaning of extracted values against values worked out by hand, and the queries against their SQL."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from webgrain.functions import cleanup
from webgrain.plans import cleanup_queries, file_queries

SF = "/root/testdata/sf0.001"


def values(spark, fn, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_list(spark):
    cells = {
        "Web design, SEO , web  DESIGN; AI | Home": "Web design, SEO, AI",
        "( , ) Logo (- signs -) ,, banners...": "Logo (signs), banners",
        "aaaaaaaa, 10 x 12, ..., ((,))": "10 x 12",
        "a, b, c, d, printing": "",
        "printing": "printing",
        "x" * 65 + "yz": "",
        "": "",
        None: "",
    }
    assert values(spark, cleanup.clean_list, list(cells)) == list(cells.values())
    assert values(spark, lambda c: cleanup.clean_field("services", c), ["one1 two, b c dd eee, fff, ggg, hhh, iii, jjj, kkk"]) == ["one1 two, b c dd eee, fff, ggg, hhh, iii"]


def test_clean_text_phone_email(spark):
    assert values(spark, cleanup.clean_text, ["12 Long  Street () , Town .", "(((---)))", "ab", None]) == ["12 Long Street, Town", "", "", ""]
    assert values(spark, cleanup.clean_phone, ["Tel: (555) 010-9999 ext 4", "12345", None]) == ["Te (555) 010-9999 ext 4", "", ""]
    assert values(spark, cleanup.clean_email, ["write a.b+c@ex-a.org, or d@e.f", "none", None]) == ["a.b+c@ex-a.org", "", ""]


def test_business_name(spark):
    rows = [
        ("Given", "x", "y", "a.com"),
        ("", "Home | Acme", "Acme Tools - Welcome", "www.acme.com"),
        (None, None, "the best page of all pages in town", "my-shop.org"),
        (None, None, None, None),
        (None, "", "home: McShop", "other.org"),
    ]
    df = spark.createDataFrame(rows, "s string, o string, t string, h string")
    got = [tuple(r[0]) for r in df.select(cleanup.business_name(*map(F.col, "soth"))).collect()]
    assert got == [("Given", "suggested"), ("Acme Tools", "title"), ("My Shop", "domain"), ("", "none"), ("McShop", "title")]


def test_shared_work_is_done_once(spark):
    """The same values as field by field; the shared cleaning stands once in the plan, and parts past the last kept item are not looked at."""
    fields = ["services", "address", "phone", "email", "brandColors"]
    cells = ["( , ) Home | 10 x 12;; aaaaaaab, (- big -) ...some text. More\xa0 text [;] a@b.co 555 010 9999", "", None, "printing, a, b, c, d", "x. ", "a;;b,, (c ) [d], e f , g.. h"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, x string")
    both = df.select("i", cleanup.clean_fields(fields, F.col("x")).alias("v"), *(cleanup.clean_field(f, F.col("x")).alias(f) for f in fields)).collect()
    assert all(r["v"][f] == r[f] for r in both for f in fields) and both[3]["services"] == ""
    plan = cleanup_queries.extracted_value_cleanup(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\.{2,}") == 2  # once in whole texts and once in parts


def test_long_run_of_word_characters_without_an_address(spark):
    assert values(spark, cleanup.clean_email, ["a" * 300_000, "b" * 300_000 + "@x", "c" * 9 + "@x, d.e@f-g.org."]) == ["", "", "d.e@f-g.org."]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [*cleanup_queries.QUERIES, *file_queries.QUERIES])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute((cleanup_queries.SQL | file_queries.SQL)[name])
    names = sorted(d[0] for d in want.description)
    expected = Counter(tuple(dict(zip((d[0] for d in want.description), row, strict=True))[n] for n in names) for row in want.fetchall())
    got = (cleanup_queries.QUERIES | file_queries.QUERIES)[name](spark, SF)
    assert sorted(got.columns) == names and len(expected) >= 50
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == expected
