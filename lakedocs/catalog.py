"""All registered queries of the library, with their SQL."""

from __future__ import annotations

from .plans import queries_parts, queries_reports, queries_search, queries_streams

FLAGSHIP = "K5_keyword_topk"
MODULES: list = [queries_reports, queries_search, queries_parts, queries_streams]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
