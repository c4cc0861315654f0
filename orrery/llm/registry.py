"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from orrery.llm import bpe, fingerprint, jaccard, language, licenses, packing, pii, secrets, topk, urlfilter

MODULES = (urlfilter, licenses, secrets, pii, topk, language, fingerprint, jaccard, packing, bpe)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
