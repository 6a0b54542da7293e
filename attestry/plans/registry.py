"""Collects the registered queries."""

from __future__ import annotations

from . import catalogue, documents, evaluation, evidence, markup, nested, questions, records, retrieval, service, storage, structure, terms

MODULES = (retrieval, catalogue, documents, evidence, evaluation, service, terms, records, storage, nested, questions, markup, structure)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
