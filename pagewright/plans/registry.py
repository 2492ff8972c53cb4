"""Every query of the library with the SQL that states the same, where SQL can."""

from __future__ import annotations

from pagewright.plans import language_queries, made_queries, markup_queries, outcome_queries, page_queries, relational_queries, security_queries, source_queries, stream_queries, url_queries

_MODULES = (security_queries, url_queries, language_queries, relational_queries, made_queries, markup_queries, outcome_queries, page_queries, source_queries, stream_queries)

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
