"""The library's own queries (without the llm subpackage)."""

from __future__ import annotations

from . import accounts, billing, content, documents, links, network, records, shapes, tracks

MODULES = (billing, tracks, records, network, content, links, accounts, shapes, documents)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
