"""SQL of the full merge: a recursive table that takes one attempt of each site after the other."""

from __future__ import annotations

from webgrain.operators import merge
from webgrain.plans import inputs as I
from webgrain.plans import url_sql as S

_FILL = [c for c in merge.FILLED if c not in ("extraction_run_id", "processed_at")]
_OTHER = [c for c in merge.COUNTED if c not in (*_FILL, "extracted_addresses") and c in I.REVIEWS]
_KEPT = ["seq", "normalized_url", "domain", "canonical_domain", "status", "error_message", "elapsed_ms", "extracted_products", "extracted_services", "extracted_products_services", "pages_inspected", "overall_score", "brief_score", "reviewer_notes", "extraction_run_id", "processed_at", "source_review_queue"]
_WWW = "regexp_matches({0}, '^(?i)(https?://)?www[.]')"
_STATUS = "CASE WHEN lower(status) IN ('success', 'ok', 'completed') THEN 3 WHEN status = '' THEN 1 ELSE 2 END"
_VARIANT = "{'normalized_url': nullif(normalized_url, ''), 'domain': nullif(domain, ''), 'canonical_domain': nullif(canonical_domain, ''), 'source_column': nullif(source_column, '')}"


def _contact(x: str) -> str:
    return " + ".join(f"CAST({x}.{c} <> '' AS INT)" for c in ("extracted_emails", "extracted_phone_numbers", "extracted_social_links", "extracted_addresses"))


def _n_colors(x: str) -> str:
    return f"len(list_distinct(list_filter(list_prepend({x}.primary_color_hex, list_prepend({x}.secondary_color_hex, CAST(CASE WHEN {x}.extracted_color_hexes = '' THEN '[]' ELSE {x}.extracted_color_hexes END AS JSON) ::VARCHAR[])), lambda h: h <> '')))"


def _gains(old: str, new: str) -> str:
    logo = "({0}.selected_logo_url <> '' OR {0}.logo_candidate_urls <> '' OR {0}.logo_candidate_count NOT IN ('', '0'))"
    offers = "({0}.extracted_products <> '' OR {0}.extracted_services <> '' OR {0}.extracted_products_services <> '')"
    fresh = [logo, offers, "({0}.extracted_summary <> '')", "({0}.palette_source <> '')"]
    rules = [f"(NOT {r.format(old)} AND {r.format(new)})" for r in fresh]
    more = [f"({_n_colors(old)} = 0 AND {_n_colors(new)} > 0)", f"{_n_colors(new)} >= {_n_colors(old)} + 3", f"coalesce(TRY_CAST({new}.overall_score AS DOUBLE) - TRY_CAST({old}.overall_score AS DOUBLE) >= 1, false)"]
    return "(" + " OR ".join([*rules, *more]) + ")"


def _richer(old: str, new: str) -> str:
    return f"(({_contact(old)}) > ({_contact(new)}) AND NOT {_gains(old, new)})"


def _priority(x: str) -> str:
    counted = " + ".join(f"CAST({x}.{c} <> '' AS INT)" for c in (*(c for c in _FILL if c in merge.COUNTED), "extracted_addresses"))
    return f"(CASE WHEN {x}.status = '' THEN 0 WHEN {x}.status = 'success' THEN 1500000 ELSE 1200000 END + 1000 * ({x}.n_other + {counted}) + {x}.t + CASE WHEN {x}.www THEN 0 ELSE 1 END)"


_LATER = f"(b.t > a.t OR (b.t = a.t AND {_priority('b')} > {_priority('a')}))"
_FIRST = f"""CASE WHEN a.rank <> b.rank THEN a.rank > b.rank WHEN a.rank = 3 THEN CASE WHEN {_LATER} THEN {_richer("a", "b")} ELSE NOT {_richer("b", "a")} END
  WHEN a.t <> b.t THEN a.t > b.t WHEN {_priority("a")} <> {_priority("b")} THEN {_priority("a")} > {_priority("b")} ELSE NOT (a.www AND NOT b.www) END"""
_VKEY = "coalesce('url:' || lower({0}.normalized_url), 'domain:' || lower({0}.domain))"
_NEWER, _OLDER = "(CASE WHEN a.t >= b.t THEN a ELSE b END)", "(CASE WHEN a.t >= b.t THEN b ELSE a END)"

MERGE_SQL = f"""
WITH RECURSIVE r AS ({I.sql(I.REVIEWS)}),
p AS MATERIALIZED (
  SELECT attempt_key, row_number() OVER (PARTITION BY attempt_key ORDER BY seq) AS nr, {", ".join(dict.fromkeys([*_KEPT, *_FILL, "extracted_addresses"]))},
    epoch_ms(CAST(replace(replace(processed_at, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS t, {_STATUS} AS rank, {_WWW.format("domain")} OR {_WWW.format("normalized_url")} AS www,
    {" + ".join(f"CAST({c} <> '' AS INT)" for c in _OTHER)} AS n_other, {_VARIANT} AS variant, [] :: STRUCT(normalized_url VARCHAR, "domain" VARCHAR, canonical_domain VARCHAR, source_column VARCHAR)[] AS variants,
    status AS latest_status, processed_at AS latest_at, '' AS previous, '' AS richer, 1 AS n
  FROM (SELECT *, {S.site_key("canonical_domain", "domain", "normalized_url", "''")} AS attempt_key FROM r)
), fold AS (
  SELECT * FROM p WHERE nr = 1
  UNION ALL
  SELECT a.attempt_key, b.nr, {", ".join(f"k.{c}" for c in _KEPT)}, {", ".join(f"CASE WHEN k.{c} = '' THEN o.{c} ELSE k.{c} END AS {c}" for c in _FILL)},
    CASE WHEN k.extracted_addresses = '' THEN o.extracted_addresses ELSE k.extracted_addresses END, k.t, k.rank, k.www, k.n_other,
    {{'normalized_url': k.variant.normalized_url, 'domain': k.variant.domain, 'canonical_domain': k.variant.canonical_domain, 'source_column': coalesce(k.variant.source_column, o.variant.source_column)}},
    list_filter(spelled, lambda v, i: list_position(list_transform(spelled, lambda w: {_VKEY.format("w")}), {_VKEY.format("v")}) = i),
    {_NEWER}.status, {_NEWER}.processed_at,
    CASE WHEN {_OLDER}.rank = 3 AND {_NEWER}.rank = 2 AND is_first <> (a.t >= b.t) THEN 'true' ELSE '' END,
    CASE WHEN a.rank = 3 AND b.rank = 3 AND is_first <> (a.t >= b.t) AND CASE WHEN a.t >= b.t THEN {_richer("b", "a")} ELSE {_richer("a", "b")} END THEN 'true' ELSE '' END, a.n + 1
  FROM (
    SELECT *, list_filter(list_concat(list_concat(a.variants, b.variants), [o.variant]), lambda v: {_VKEY.format("v")} <> {_VKEY.format("k.variant")}) AS spelled
    FROM (SELECT *, CASE WHEN is_first THEN a ELSE b END AS k, CASE WHEN is_first THEN b ELSE a END AS o FROM (SELECT *, {_FIRST} AS is_first FROM (SELECT fold AS a, p AS b FROM fold JOIN p ON p.attempt_key = fold.attempt_key AND p.nr = fold.nr + 1)))
  )
)
SELECT attempt_key, {", ".join(c for c in I.REVIEWS if c in (*_KEPT, *_FILL, "extracted_addresses") and c not in ("project_type", "shop_code"))},
  CASE WHEN len(variants) = 0 THEN '' ELSE '[' || array_to_string(list_transform(variants, lambda v: '{{' || array_to_string(list_filter([
    '"normalized_url":' || CAST(to_json(v.normalized_url) AS VARCHAR), '"domain":' || CAST(to_json(v.domain) AS VARCHAR), '"canonical_domain":' || CAST(to_json(v.canonical_domain) AS VARCHAR), '"source_column":' || CAST(to_json(v.source_column) AS VARCHAR)
  ], lambda x: x IS NOT NULL AND x NOT LIKE '%:null'), ',') || '}}'), ',') || ']' END AS duplicate_source_urls,
  latest_status AS latest_rerun_status, latest_at AS latest_rerun_timestamp, previous AS preserved_previous_success, richer AS preserved_richer_contact, CAST(n AS BIGINT) AS n_attempts
FROM fold QUALIFY row_number() OVER (PARTITION BY attempt_key ORDER BY nr DESC) = 1
"""
