"""Walking records of any depth, routing their leaves, and the rows that come out."""

import json

import pytest
from pyspark.sql import functions as F

from webgrain.operators import records

EXPO = {
    "ok": True,
    "business": {"name": "Acme Co", "website": "", "domain": "", "canonicalUrl": ""},
    "brand": {"colors": [], "typography": {}, "logoCandidates": [{"url": "https://example.com/logo.png"}]},
    "content": {
        "services": ["Trade show booths", "Event signage"],
        "products": ["Backdrop displays"],
        "contact": {
            "email": "hello@acme.co",
            "phone": "(555) 010-2030",
            "address": "123 Booth Ave, Austin, TX",
            "social": ["https://instagram.com/acme", "https://linkedin.com/company/acme"],
        },
    },
    "designIntake": {"productCategory": "Trade show booth", "recommendedHeadline": "Acme Co", "recommendedSupportingText": "We build booths."},
    "metadata": {"source": "scraper_plus", "pagesInspected": 3, "claude": {"model": "test", "attempted": True}},
}
INPUT = {"ds_id": "x", "ds_number": "DS-1", "project_title": "Acme Booth", "domain": "www.Example.com", "canonical_domain": "", "first_req_description": "Long " * 100, "first_req_note": ""}


def rows(spark, *expos, **extra):
    df = spark.createDataFrame([(k, json.dumps({"input": INPUT, "status": "success", "elapsed_ms": 1200, "expo_output": e} | extra)) for k, e in enumerate(expos)], "k int, record string")
    return [r for r in records.review_rows(df).orderBy("k").collect()]


def test_whole_record(spark):
    (row,) = rows(spark, EXPO)
    assert row["extracted_business_name"] == "Acme Co" and row["extracted_tagline"] == "" and row["extracted_summary"] == "We build booths."
    assert json.loads(row["extracted_emails"]) == ["hello@acme.co"] and json.loads(row["extracted_phone_numbers"]) == ["(555) 010-2030"]
    assert [s["label"] for s in json.loads(row["extracted_social_links"])] == ["Instagram", "LinkedIn"]
    assert json.loads(row["extracted_addresses"]) == ["123 Booth Ave, Austin, TX"]
    assert json.loads(row["extracted_products_services"]) == ["Backdrop displays", "Trade show booths", "Event signage"]
    assert row["logo_candidate_count"] == "1" and row["pages_inspected"] == "3" and row["elapsed_ms"] == "1200"
    assert row["canonical_domain"] == "example.com" and len(row["first_req_description_excerpt"]) == 240
    assert row["title_business_name_overlap_hint"] == row["business_name_similarity_hint"] == "high"


def test_colours_and_their_origin(spark):
    got = rows(
        spark,
        {"designSpec": {"brandColors": {"navy": "#0B2E4A", "teal": "#2BB3A3"}}},
        {"brand": {"colors": ["#112233"], "paletteSource": "extraction", "paletteConfidence": "high"}},
        {"brand": {"colors": ["#112233"]}, "paletteSource": "logo_fallback"},
        {"brand": {"colors": ["#112233"]}, "metadata": {"warnings": ["Colors come from the logo image (palette fallback)"]}},
        {"palette": {"url": "#445566", "logo": {"x": "#445566"}}},
        {"palette": ["Primary #abc", "accent #001122", "#FFF"]},
    )
    assert (got[0]["primary_color_hex"], got[0]["secondary_color_hex"], got[0]["palette_source"], got[0]["palette_confidence"]) == ("#0b2e4a", "#0b2e4a", "extraction", "unknown")
    assert (got[1]["palette_source"], got[1]["palette_confidence"], got[1]["palette_category"]) == ("extraction", "high", "explicit_extraction")
    assert (got[2]["palette_source"], got[2]["palette_distinct_color_count"]) == ("logo", "1")
    assert (got[3]["palette_source"], got[3]["palette_confidence"], got[3]["palette_category"]) == ("logo", "medium", "logo_fallback")
    assert got[4]["extracted_color_hexes"] == "" and got[4]["palette_category"] == "no_colors" and got[4]["color_paths"] == ""
    assert json.loads(got[5]["extracted_color_hexes"]) == ["#aabbcc", "#001122", "#ffffff"] and got[5]["secondary_color_hex"] == "#001122"


def test_names_hide_the_rest_of_an_offering(spark):
    (row,) = rows(spark, {"content": {"products": [{"name": "N", "price": "3", "more": {"title": "T"}}, {"title": " ", "label": "L"}, {"a": {"label": "L2", "x": "no"}}, "n"]}, "SERVICES": {"q": [["S"]]}, "offering": "O " * 200})
    assert json.loads(row["extracted_products"]) == ["N", "L", "L2"]
    assert json.loads(row["extracted_services"]) == ["S"]
    assert [len(x) for x in json.loads(row["extracted_products_services"])] == [160, 1, 1, 2, 1]


def test_caps_and_first_ones(spark):
    (row,) = rows(spark, {"emails": [f"A{k // 2}@x.org" for k in range(40)], "addresses": [f"{k} Long  Street" for k in range(9)] + ["0 long street"], "links": {"blog": [f"https://h.org/{k}" for k in range(20)]}})
    assert json.loads(row["extracted_emails"]) == [f"a{k}@x.org" for k in range(8)]
    assert json.loads(row["extracted_addresses"]) == [f"{k} Long Street" for k in range(4)]
    assert json.loads(row["extracted_contact_links"])[0] == {"label": "blog", "url": "https://h.org/0"}


def test_no_records_no_output_and_no_json(spark):
    (row,) = rows(spark, None)
    assert row["status"] == "success" and row["extracted_emails"] == "" and row["logo_candidate_count"] == "" and row["palette_source"] == ""
    df = spark.createDataFrame([(1, "{bad", "a"), (2, None, "b"), (3, "", "c"), (4, "[1]", "d"), (5, "{}", "e")], "k int, record string, status string")
    assert {r["k"] for r in records.bad_records(df).collect()} == {1, 2, 3}
    out = {r["k"]: r for r in records.review_rows(df).collect()}
    assert set(out) == {4, 5} and out[5]["status"] == "" and out[5]["canonical_domain"] == ""
    assert records.review_rows(df.limit(0)).count() == 0


def test_order_kinds_and_any_depth(spark):
    value = {"b": 1, "10": "x", "2": [True, None, 1.5, {"c": "y"}], "a": 2.0}
    assert records.leaves_of(value) == [
        (["2", None], "boolean", "true", -1), (["2", None], "number", "1.5", -1), (["2", None, "c"], "string", "y", -1), (["10"], "string", "x", -1),
        (["b"], "number", "1", -1), (["a"], "number", "2", -1),
    ]
    deep = '{"contact":' + '{"a":[' * 50_000 + '"hi@deep.org"' + "]}" * 50_000 + "}"
    df = spark.createDataFrame([(f'{{"expo_output":{deep}}}',)], "record string")
    assert records.review_rows(df).first()["extracted_emails"] == '["hi@deep.org"]'


@pytest.mark.parametrize("text", ['{"a": [1, {"b": "x\\"}]"}, []], "a": {"c": null}, "e": "\\u00e9"}', "[]", '"x"', "{}", " [ [ ] , 1e3 ] "])
def test_deep_parser_agrees(text):
    assert records._parse_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a"}', "[1 2]", "{}}", '{"a":1,}', '{"a":}', "]", '["a]'])
def test_deep_parser_refuses(text):
    with pytest.raises(ValueError):
        records._parse_deep(text)


def test_palette_category_and_paths(spark):
    df = spark.createDataFrame([('{"brand":{"colors":["#fff"]},"palette":{"logo":"#111"},"metadata":{"colors":[" "]}}',)], "r string").withColumn("x", records.leaves("r"))
    assert [(p["path"], p["present"]) for p in df.select(records.color_paths(F.col("x"))).first()[0] if p["present"]] == [("brand.colors", True)]
