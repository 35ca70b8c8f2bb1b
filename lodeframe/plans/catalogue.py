"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from . import evidence, extras, general_problems, linked, records, relational, shapes, streams, texts

MODULES = [general_problems, relational, texts, shapes, streams, records, evidence, extras, linked]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
