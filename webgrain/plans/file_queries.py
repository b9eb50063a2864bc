"""A query through written files of the fixed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webgrain.plans import inputs
from webgrain.shared import new_path
from webgrain.sources import typed


def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "candidates")
    typed.write_typed(inputs.derive(spark, sf_dir, inputs.CANDIDATES | {"first_req_note": 'concat(\'a "b", \', url, chr(10), \'c\')'}), path, typed.CANDIDATES)
    return typed.read_candidates(spark, path).select("ds_number", "raw_url", "normalized_url", "domain", "canonical_domain", "source_column", "shop_code", "first_req_note")


QUERIES = {"candidate_files": candidate_files}

SQL = {
    "candidate_files": f"""SELECT ds_number, trim(raw_url) AS raw_url, normalized_url, domain,
        CASE WHEN canonical_domain <> '' THEN canonical_domain ELSE regexp_replace(lower(domain), '^www[.]', '') END AS canonical_domain, source_column, '' AS shop_code, 'a "b", ' || url || chr(10) || 'c' AS first_req_note
      FROM (SELECT *, (SELECT url FROM pages WHERE page_id = seq) AS url FROM ({inputs.sql(inputs.CANDIDATES)}))""",
}
