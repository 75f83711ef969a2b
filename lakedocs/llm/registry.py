"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, html_text, jaccard, lines, negatives, packing, quality, sharding, simhash, spelling, substrings, token_files, warc

MODULES = [token_files, packing, sharding, jaccard, lines, decontamination, warc, quality, simhash, substrings, negatives, spelling, html_text]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLE", {}).items()}
