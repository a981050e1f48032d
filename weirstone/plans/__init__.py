"""The query catalogue: every query of the core, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import analysis, documents, etl, evidence, lookups, nested, ordered, sources, units

_PARTS = [etl, ordered, analysis, documents, lookups, evidence, units, sources, nested]


def queries():
    out = {}
    for part in _PARTS:
        out |= part.queries()
    return out


def oracle_sql():
    out = {}
    for part in _PARTS:
        out |= part.oracle_sql() if hasattr(part, "oracle_sql") else {}
    return out
