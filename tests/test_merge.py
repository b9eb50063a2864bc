"""The full merge: outcomes of pairs, stamps that are inferred, variants, and folding by segments."""

import json
import random

import pytest

from webgrain.operators import merge
from webgrain.sources import typed

SITE = {"normalized_url": "https://example.com/", "domain": "example.com", "canonical_domain": "example.com"}


def at(day, **cells):
    stamp = f"202606{day:02d}000000000"
    return SITE | {"processed_at": f"2026-06-{day:02d}T00:00:00.000Z", "extraction_run_id": stamp, "source_review_queue": f"review_queue_{stamp}.csv", "status": "success"} | cells


def frame(spark, rows):
    return spark.createDataFrame([tuple([k] + [r.get(c, "") for c in typed.REVIEWS]) for k, r in enumerate(rows)], "seq long, " + ", ".join(f"{c} string" for c in typed.REVIEWS))


def merged(spark, *rows, **how):
    return merge.merge_attempts(frame(spark, rows), **how).collect()


INSTAGRAM = '[{"label":"Instagram","url":"https://www.instagram.com/example"}]'


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        (at(1, extracted_business_name="Kept Co"), at(22, status="fetch_error", error_message="timeout"), {"status": "success", "extracted_business_name": "Kept Co", "latest_rerun_status": "fetch_error", "preserved_previous_success": "true", "latest_rerun_timestamp": "2026-06-22T00:00:00.000Z"}),
        (at(1, extracted_business_name="Old"), at(22, extracted_business_name="New"), {"extracted_business_name": "New", "latest_rerun_status": "success", "preserved_previous_success": ""}),
        (at(1, extracted_emails="hello@example.com", extracted_color_hexes='["#f4ece2"]', extracted_social_links=INSTAGRAM), at(22, extracted_emails="hello@example.com", extracted_color_hexes='["#f4ece2","#1d1a13"]'), {"extracted_social_links": INSTAGRAM, "preserved_richer_contact": "true", "extracted_color_hexes": '["#f4ece2"]'}),
        (at(1, extracted_emails="hello@example.com"), at(22, extracted_color_hexes='["#f4ece2"]'), {"preserved_richer_contact": "", "extracted_emails": "hello@example.com", "extracted_color_hexes": '["#f4ece2"]', "processed_at": "2026-06-22T00:00:00.000Z"}),
        (at(1, ds_number="15607"), at(22, status="fetch_error"), {"ds_number": "15607", "status": "success"}),
        (at(1, ds_number="15607", extracted_emails="a@b.co"), at(22, extracted_emails="a@b.co", extracted_phone_numbers='["555-010-0199"]'), {"ds_number": "15607", "extracted_phone_numbers": '["555-010-0199"]'}),
        (at(1, extracted_addresses="https://facebook.com/acme"), at(22, status="error", extracted_addresses="12 Long Street"), {"extracted_addresses": "12 Long Street", "status": "success"}),
        (at(1, processed_at="", extraction_run_id="", source_review_queue="review_queue_20260601000000000.csv"), at(22, status="error", processed_at="", extraction_run_id=""), {"extraction_run_id": "20260601000000000", "processed_at": "2026-06-01T00:00:00.000Z", "latest_rerun_timestamp": "2026-06-22T00:00:00.000Z"}),
        (at(5, domain="www.example.com", normalized_url="https://www.example.com/", status="error"), at(5, status="error"), {"domain": "example.com"}),
    ],
)
def test_pairs(spark, old, new, want):
    (row,) = merged(spark, old, new)
    assert {k: row[k] for k in want} == want and row["n_attempts"] == 2


def test_variants_and_their_labels(spark):
    rows = [at(1), at(2, domain="www.example.com", normalized_url="https://WWW.example.com/", source_column="x"), at(3, duplicate_source_urls='[{"domain":"alias.org"},{"raw_url":"Raw"},7,{}]'), at(4, normalized_url="https://www.example.com/")]
    (row,) = merged(spark, *rows)
    listed = json.loads(row["duplicate_source_urls"])
    assert [v.get("normalized_url", v.get("domain", v.get("raw_url"))) for v in listed] == ["alias.org", "Raw", "https://example.com/"]
    df = frame(spark, rows[2:3])
    assert df.select(merge.shown_variants(df["duplicate_source_urls"])).first()[0] == ["alias.org", "Raw"]


def test_segments_give_the_same_rows(spark):
    draw = random.Random(5)
    cells = {"extracted_emails": ["", "a@b.co"], "extracted_phone_numbers": ["", '["555 010 9999"]'], "extracted_social_links": ["", INSTAGRAM], "extracted_addresses": ["", "x", '["12 Long Street"]'], "extracted_color_hexes": ["", '["#112233"]', '["#112233","#445566","#778899"]'], "primary_color_hex": ["", "#112233"], "extracted_summary": ["", "s"], "selected_logo_url": ["", "l"], "overall_score": ["", "1", "3"], "status": ["success", "success", "error", ""], "ds_number": ["", "1", "2"], "extraction_run_id": ["", "20260601000000"], "processed_at": ["", "2026-06-09T00:00:00.000Z", "2026-06-05T00:00:00.000Z"], "domain": ["example.com", "www.example.com"]}
    rows = [at(draw.randrange(1, 28)) | {c: draw.choice(v) for c, v in cells.items()} | {"normalized_url": f"https://{draw.choice('ab')}.org/"} for _ in range(60)]
    rows = [r | {"canonical_domain": "", "domain": r["domain"] if draw.random() < 0.5 else ""} for r in rows]
    whole = sorted(map(str, merged(spark, *rows)))
    assert whole == sorted(map(str, merged(spark, *rows, segment=7))) and sum(json.loads(f"{r.n_attempts}") for r in merged(spark, *rows, segment=25)) == 60


def test_a_site_with_very_many_rows(spark):
    rows = [at(1 + k % 27, ds_number="" if k else "7", extracted_business_name=f"n{k}") for k in range(3000)]
    (row,) = merged(spark, *rows, segment=1000)
    assert row["n_attempts"] == 3000 and row["ds_number"] == "7" and row["processed_at"].startswith("2026-06-27")


def test_rows_of_one_and_none(spark):
    (row,) = merged(spark, at(3, duplicate_source_urls="odd"))
    assert row["duplicate_source_urls"] == "odd" and row["latest_rerun_status"] == "success" and row["n_attempts"] == 1
    assert merged(spark, SITE)[0]["latest_rerun_status"] == ""
    assert merge.merge_attempts(frame(spark, [at(1)]).limit(0)).count() == 0


def test_combining_files(spark, tmp_path):
    typed.write_typed(frame(spark, [at(1, ds_number="9"), at(2, normalized_url="https://a.org/x", domain="a.org", canonical_domain="a.org")]).coalesce(1), f"{tmp_path}/one", typed.REVIEWS)
    typed.write_typed(frame(spark, [at(22, status="fetch_error", error_message='a "quoted", cell')]).coalesce(1), f"{tmp_path}/two", typed.REVIEWS)
    for name, stamp in (("one", "20260601000000000"), ("two", "20260622000000000")):
        (part,) = (tmp_path / name).glob("part-*.csv")
        part.rename(tmp_path / f"review_queue_{stamp}.csv")
    assert merge.combine_review_queues(spark, str(tmp_path), f"{tmp_path}/out") == {"rows_read": 3, "rows_written": 2}
    rows = spark.read.csv(f"{tmp_path}/out", header=True, multiLine=True, quote='"', escape='"').collect()
    assert [r["normalized_url"] for r in rows] == ["https://a.org/x", "https://example.com/"]
    assert rows[1]["preserved_previous_success"] == "true" and rows[1]["ds_number"] == "9" and rows[1]["source_review_queue"] == "review_queue_20260601000000000.csv"
