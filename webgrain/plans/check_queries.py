"""Assertions on the extraction records, and their verdicts over the runs of each kind of record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webgrain.operators import checks, scores
from webgrain.plans.record_queries import RECORD

#: (check_id, type, path, severity, expected, substring, substrings, paths, min); each holds for all fixtures.
CHECKS = [
    ("c01", "exact", "expo_output.metadata.pagesInspected", "required", "3", None, None, None, None),
    ("c02", "exact", "status", "required", '"success"', None, None, None, None),
    ("c03", "exact", "expo_output.brand.paletteSource", "nice_to_have", '"Explicit"', None, None, None, None),
    ("c04", "pathIncludes", "expo_output.business.name", "required", None, "A", None, None, None),
    ("c05", "pathNotIncludes", "error_message", "required", None, "403", None, None, None),
    ("c06", "arrayIncludes", "expo_output.content.services", "required", None, "e", None, None, None),
    ("c07", "arrayIncludes", "expo_output.brand.logoCandidates", "required", None, "IMG", None, None, None),
    ("c08", "anyArrayIncludes", None, "required", None, "zzz", ["an", "TH"], ["expo_output.palette", "expo_output.content.products", "expo_output.emails"], None),
    ("c09", "exists", "expo_output.business.canonicalUrl", "nice_to_have", None, None, None, None, None),
    ("c10", "countGte", "expo_output.content.products", "required", None, None, None, None, 3),
    ("c11", "countGte", "expo_output.metadata.pagesInspected", "required", None, None, None, None, 1),
    ("c12", "logoCandidateSource", "expo_output.brand.logoCandidates[0].source", "required", '"img"', None, None, None, None),
    ("c13", "pathIn", "status", "required", '["success", "partial"]', None, None, None, None),
    ("c14", "exact", "expo_output.contact.offices.1.location", "required", '{"city":"The"}', None, None, None, None),
    ("c15", "pathIncludes", "expo_output.content.contact.social", "required", None, "instagram.com/t", None, None, None),
    ("c16", "noSuchType", "status", "nice_to_have", None, None, None, None, None),
    ("c17", "countGte", "expo_output.brand.colors.length", "required", None, None, None, None, 2),
]
_SCHEMA = "check_id string, type string, path string, severity string, expected string, substring string, substrings array<string>, paths array<string>, min int"
_RUN = [
    f"concat('kind ', CAST(page_id % 5 AS STRING), CASE WHEN length({RECORD}) % 2 = 0 THEN ' even' ELSE ' odd' END) AS fixture",
    "page_id AS run",
    f"{RECORD} AS response",
    "CASE WHEN page_id % 5 = 4 THEN 500 ELSE 200 END AS http_status",
    "CASE WHEN page_id % 5 = 4 THEN 'cut off' END AS fetch_error",
]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(*_RUN)


def _checks(spark: SparkSession, runs: DataFrame) -> DataFrame:
    return runs.select("fixture").distinct().crossJoin(spark.createDataFrame(CHECKS, _SCHEMA))  # few fixtures, as many checks as listed


def assertion_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return checks.run_checks(_checks(spark, runs), runs).select("fixture", "check_id", "run", "severity", "passed")


def assertion_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return checks.fixture_verdicts(checks.check_verdicts(checks.run_checks(_checks(spark, runs), runs)), runs)


_SCORED = [
    "CAST(page_id AS STRING) AS run_id", "CAST(page_id % 50 AS STRING) AS ds_id", "CASE WHEN page_id % 3 = 0 THEN NULL ELSE concat('DS-', CAST(page_id AS STRING)) END AS ds_number", "url AS website_url",
    "CASE WHEN page_id % 2 = 0 THEN 'website_only' ELSE 'website_plus_requirements' END AS mode",
    "CASE page_id % 7 WHEN 0 THEN 'skipped' WHEN 1 THEN 'error' WHEN 2 THEN 'dry_run' ELSE 'success' END AS status",
    "regexp_extract(html, '<title>([^<]*)</title>', 1) AS project_title",
    "CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'ex' ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) END AS shop_code",
    "regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1) AS first_req_description", "CASE WHEN page_id % 3 = 1 THEN '' ELSE 'a note' END AS first_req_note",
    "CASE WHEN page_id % 2 = 0 THEN 'no url' END AS skip_reason", "CASE WHEN page_id % 14 = 1 THEN 'HTTP 500' END AS error_message", "'as asked' AS customer_instructions",
    "concat('{\"ok\":', CASE page_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END, ',\"business\":{\"name\":\" N', CAST(page_id AS STRING), ' \",\"domain\":\"', CASE WHEN page_id % 5 = 0 THEN '' ELSE regexp_extract(url, '^https?://([^/?#]+)', 1) END, '\"}', CASE WHEN page_id % 4 = 3 THEN '' ELSE ',\"brand\":{\"logoCandidates\":[{},2]}' END, '}') AS response",
]


def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.field_scores(spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(*_SCORED))


def _quoted(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(map(_quoted, v)) + "]"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


_ROWS = ", ".join(f"({', '.join(map(_quoted, row))})" for row in CHECKS)
_PATH = r"'$.' || regexp_replace(regexp_replace({0}, '[.]length$', ''), '[.]([0-9]+)', '[\1]', 'g')"
_ITEM = "lower(CASE WHEN json_type(i) = 'VARCHAR' THEN i ->> '$' ELSE CAST(i AS VARCHAR) END)"


def _list(doc: str, path: str) -> str:
    return f"CASE WHEN json_type({doc}, {path}) = 'ARRAY' THEN CAST(json_extract({doc}, {path}) AS JSON[]) ELSE [] END"


_RESULTS = rf"""r AS MATERIALIZED (SELECT *, CASE WHEN json_valid(response) THEN CAST(response AS JSON) END AS doc FROM (SELECT {", ".join(_RUN)} FROM pages)),
c(check_id, type, path, severity, expected, substring, substrings, paths, least) AS (VALUES {_ROWS}),
v AS (SELECT r.fixture, r.run, r.doc, c.*, {_PATH.format("path")} AS jp FROM r, c),
w AS (SELECT *, json_type(doc, jp) AS kind, json_extract(doc, jp) AS actual FROM v),
x AS (SELECT *, CASE WHEN kind IS NULL OR kind = 'NULL' THEN '' WHEN kind = 'ARRAY' THEN array_to_string(list_transform(CAST(actual AS JSON[]), lambda i: i ->> '$'), ',') WHEN kind = 'OBJECT' THEN '[object Object]' ELSE actual ->> '$' END AS shown FROM w),
results AS (SELECT fixture, check_id, run, severity, coalesce(CASE type
    WHEN 'pathIncludes' THEN shown <> '' AND contains(lower(shown), lower(substring)) WHEN 'pathNotIncludes' THEN shown = '' OR NOT contains(lower(shown), lower(substring))
    WHEN 'arrayIncludes' THEN len(list_filter({_list("doc", "jp")}, lambda i: contains({_ITEM}, lower(substring)))) > 0
    WHEN 'anyArrayIncludes' THEN len(list_filter(flatten(list_transform(paths, lambda p: {_list("doc", _PATH.format("p"))})), lambda i: len(list_filter(list_append(substrings, substring), lambda n: contains({_ITEM}, lower(n)))) > 0)) > 0
    WHEN 'exists' THEN kind IS NOT NULL AND kind <> 'NULL' AND NOT (kind = 'VARCHAR' AND trim(shown) = '')
    WHEN 'countGte' THEN CASE WHEN kind = 'ARRAY' THEN json_array_length(actual) WHEN kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(shown AS DOUBLE) ELSE 0 END >= least
    WHEN 'pathIn' THEN kind = 'VARCHAR' AND list_contains(CAST(CAST(expected AS JSON) AS VARCHAR[]), shown)
    WHEN 'noSuchType' THEN false ELSE CAST(actual AS VARCHAR) = CAST(CAST(expected AS JSON) AS VARCHAR) END, false) AS passed FROM x)"""

QUERIES = {"assertion_results": assertion_results, "assertion_verdicts": assertion_verdicts, "field_scores": field_scores}

_PLAIN = "regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^https?://', ''), '^www[.]', ''), '/+$', '')"


def _exact(e: str, f: str) -> str:
    """Score, method and notes as a list."""
    return f"""CASE WHEN trim({e}) = '' AND trim({f}) = '' THEN ['N/A', 'missing', '{scores.BOTH_EMPTY}'] WHEN trim({e}) = '' THEN ['N/A', 'missing', '{scores.NO_HISTORY}'] WHEN trim({f}) = '' THEN ['0', 'missing', '{scores.NOTHING_FOUND}']
      WHEN contains({_PLAIN.format(e)}, {_PLAIN.format(f)}) OR contains({_PLAIN.format(f)}, {_PLAIN.format(e)}) THEN ['3', 'exact', '{scores.MATCHED}'] ELSE ['review', 'review', '{scores.UNMATCHED}'] END"""


_FIELDS = [
    ("extract.ok", "'true'", "ok", _exact("'true'", "ok")),
    ("business.name", "project_title", "name", f"['review', 'review', '{scores.NAME_NOTE}']"),
    ("business.domain", "shop_code", "found", _exact("shop_code", "found")),
    ("designIntake.recommendedHeadline", "wanted", "''", f"['review', 'review', '{scores.HEADLINE_NOTE}']"),
    ("brand.logoCandidates", "''", "logos", f"CASE WHEN logos = '' THEN ['0', 'missing', '{scores.MISSING}'] ELSE ['review', 'review', '{scores.NO_BASELINE}'] END"),
    ("brand.logo", "''", "CASE WHEN logos = '' THEN '' ELSE 'candidates_present' END", f"['review', 'review', '{scores.LOGO_NOTE}']"),
    ("customerInstructions", "wanted", "customer_instructions", f"['review', 'review', '{scores.INSTRUCTIONS_NOTE}']"),
]
_EACH = " UNION ALL ".join(f"SELECT d.*, '{n}' AS field, {b} AS historical_value, {f} AS extracted_value, {s} AS o FROM d WHERE status = 'success'" + (" AND mode <> 'website_only'" if n == "customerInstructions" else "") for n, b, f, s in _FIELDS)
SQL = {
    "assertion_results": f"WITH {_RESULTS} SELECT * FROM results",
    "assertion_verdicts": f"""WITH {_RESULTS}, e AS (SELECT fixture, check_id, severity = 'required' AS required, count(*) AS n, count(*) FILTER (passed) AS ok FROM results GROUP BY ALL),
      k AS (SELECT fixture, count(*) FILTER (required) AS n_required, count(*) FILTER (required AND ok = n) AS n_required_passed, count(*) FILTER (required AND ok = 0) AS n_required_failed,
        count(*) FILTER (required AND ok > 0 AND ok < n) AS n_required_flaky, count(*) FILTER (NOT required AND ok < n) AS n_optional_failed FROM e GROUP BY fixture),
      f AS (SELECT fixture, count(*) AS n_runs, count(*) FILTER (fetch_error IS NOT NULL) AS n_fetch_errors, count(*) FILTER (http_status = 200) AS n_ok FROM r GROUP BY fixture)
      SELECT *, n_fetch_errors = 0 AND n_ok = n_runs AND n_required_failed = 0 AND n_required_flaky = 0 AS passed FROM f JOIN k USING (fixture)""",
    "field_scores": f"""WITH d AS (SELECT *, coalesce(nullif(json_extract_string(response, '$.ok'), 'null'), '') AS ok, trim(json_extract_string(response, '$.business.name')) AS name, json_extract_string(response, '$.business.domain') AS found,
        coalesce(CAST(json_array_length(response, '$.brand.logoCandidates') AS VARCHAR), '') AS logos, concat_ws(' | ', nullif(first_req_description, ''), nullif(first_req_note, '')) AS wanted FROM (SELECT {", ".join(_SCORED)} FROM pages)),
      e AS ({_EACH} UNION ALL SELECT d.*, '_row', '', CASE WHEN status = 'skipped' THEN '' ELSE coalesce(error_message, '') END,
        CASE status WHEN 'skipped' THEN ['N/A', 'skipped', coalesce(skip_reason, 'skipped')] WHEN 'dry_run' THEN ['N/A', 'skipped', 'dry run — no extraction'] ELSE ['N/A', 'missing', coalesce(error_message, 'error')] END FROM d WHERE status <> 'success')
      SELECT run_id, ds_id, coalesce(ds_number, '') AS ds_number, website_url, mode, status AS run_status, field, historical_value, extracted_value, o[1] AS score, o[2] AS score_method, o[3] AS notes FROM e""",
}
