"""Inputs of the queries that the driver's tables lack, derived from them.

The expressions are plain SQL that Spark and DuckDB read alike, so a query and
its SQL see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CANDIDATES = {
    "seq": "page_id",
    "ds_number": "CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('DS-', CAST(page_id AS STRING)) END",
    "raw_url": """CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat('(', url, ').')
        WHEN 2 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) WHEN 3 THEN concat(regexp_extract(url, '^(https?://[^/?#]+/[^/?#]+)', 1), '/')
        WHEN 4 THEN concat(regexp_extract(url, '^(https?://[^/?#]+/[^/?#]+)', 1), '?b=2&utm_source=x&a=1') ELSE regexp_extract(url, '^https?://(.*)$', 1) END""",
    "normalized_url": "CASE WHEN page_id % 6 = 0 THEN regexp_extract(url, '^([^?#]*)', 1) ELSE '' END",
    "domain": "CASE WHEN page_id % 9 = 0 THEN '' ELSE regexp_extract(url, '^https?://([^/?#]+)', 1) END",
    "canonical_domain": "CASE WHEN page_id % 9 < 5 THEN '' ELSE regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www[.]', '') END",
    "source_column": "CASE page_id % 3 WHEN 0 THEN 'website_url' WHEN 1 THEN 'first_req_note' ELSE 'first_req_description' END",
}

REVIEWS = {
    "seq": "page_id",
    "ds_number": "CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('DS-', CAST(page_id AS STRING)) END",
    "ds_id": "CAST(page_id AS STRING)",
    "project_title": "concat('Project ', CAST(page_id % 13 AS STRING))",
    "project_type": "''",
    "shop_code": "''",
    "source_column": "'website_url'",
    # Two thirds of the reviews are of other sites, so that some candidates have none.
    "normalized_url": """CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1)
        ELSE concat('https://old-', regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www[.]', '')) END""",
    "domain": """CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^https?://([^/?#]+)', 1)
        ELSE concat('old-', regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www[.]', '')) END""",
    "canonical_domain": "''",
    "status": "CASE page_id % 7 WHEN 0 THEN 'fetch_error' WHEN 1 THEN 'OK' WHEN 2 THEN 'odd' ELSE 'success' END",
    "error_message": "CASE WHEN page_id % 7 = 0 THEN concat('HTTP 403 for ', regexp_extract(url, '^([^?#]*)', 1), ' (blocked)') ELSE '' END",
    "elapsed_ms": "CAST(page_id * 13 % 9000 AS STRING)",
    "extracted_business_name": "CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('Name ', CAST(page_id % 17 AS STRING)) END",
    "extracted_summary": "CASE WHEN page_id % 3 = 0 THEN '' ELSE 'A summary.' END",
    "extracted_emails": """CASE WHEN page_id % 2 = 0 THEN '' ELSE '["info@example.com"]' END""",
    "extracted_phone_numbers": """CASE WHEN page_id % 3 = 1 THEN '["555 010 9999"]' ELSE '' END""",
    "extracted_social_links": """CASE WHEN page_id % 5 = 2 THEN '[{"label":"X","url":"https://x.com/a"}]' ELSE '' END""",
    "extracted_addresses": """CASE WHEN page_id % 4 = 1 THEN '["12 Long Street, Town"]' ELSE '' END""",
    "extracted_contact_links": "''",
    "extracted_products": "''",
    "extracted_services": """CASE WHEN page_id % 6 = 5 THEN '["repair"]' ELSE '' END""",
    "extracted_products_services": "''",
    "logo_candidate_count": "CASE WHEN page_id % 5 = 0 THEN '0' ELSE '1' END",
    "selected_logo_url": "CASE WHEN page_id % 5 = 0 THEN '' ELSE 'https://example.com/logo.png' END",
    "logo_candidate_urls": "''",
    "extracted_color_hexes": """CASE WHEN page_id % 3 = 2 THEN '["#112233","#abcdef"]' ELSE '' END""",
    "primary_color_hex": "CASE WHEN page_id % 11 = 3 THEN '#112233' ELSE '' END",
    "secondary_color_hex": "''",
    "palette_source": "CASE WHEN page_id % 6 = 2 THEN 'logo' ELSE '' END",
    "palette_confidence": "''",
    "pages_inspected": "CAST(page_id % 8 AS STRING)",
    "overall_score": "CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN '7' ELSE CAST(page_id % 4 AS STRING) END",
    "brief_score": "CASE WHEN page_id % 10 = 0 THEN 'bad' ELSE '2' END",
    "reviewer_notes": "CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('note ', CAST(page_id % 9 AS STRING)) END",
    "extraction_run_id": "concat('2024010', CAST(page_id % 9 + 1 AS STRING), '120000')",
    "processed_at": "concat('2024-01-', lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0'), 'T00:00:00.000Z')",
    "source_review_queue": "concat('review_queue_2024010', CAST(page_id % 9 + 1 AS STRING), '120000.csv')",
    "duplicate_source_urls": "''",
}

EXPORT = {
    "seq": "page_id",
    "ds_id": "CAST(page_id AS STRING)",
    "first_req_description": """concat('See ', CASE WHEN page_id % 2 = 0 THEN url ELSE 'nothing' END, '). Mail info@mail-host.com or visit www.shop-', CAST(page_id % 7 AS STRING), '.com, Version 2.0.1')""",
    "first_req_note": "CASE WHEN page_id % 3 = 0 THEN concat('also <', url, '> and <', url, '>') ELSE 'plain.example.org/x is near brand.io' END",
    "website_url": "CASE WHEN page_id % 4 = 0 THEN url ELSE '' END",
}


def derive(spark: SparkSession, sf_dir: str, columns: dict[str, str], table: str = "pages") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS {n}" for n, e in columns.items()))


def sql(columns: dict[str, str], table: str = "pages", where: str = "TRUE") -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table} WHERE {where}"
