"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import q_canonical, q_encoding, q_leakage, q_names, q_packing, q_survivors

MODULES = [q_names, q_canonical, q_survivors, q_packing, q_leakage, q_encoding]
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE.items()}
