"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from webgrain.plans import check_queries, cleanup_queries, file_queries, html_queries, logo_queries, record_queries, review_queries, text_queries, url_queries

_MODULES = (url_queries, review_queries, text_queries, cleanup_queries, file_queries, record_queries, html_queries, check_queries, logo_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
