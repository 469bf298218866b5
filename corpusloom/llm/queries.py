"""Queries and SQL of the subpackage."""

from __future__ import annotations

from corpusloom.llm import defects, language, leakage, mixing, neardup, packing, readability, recordings

_MODULES = (recordings, neardup, mixing, defects, language, packing, leakage, readability)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
