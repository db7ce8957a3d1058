"""All registered queries."""

from __future__ import annotations

from tracewell.plans import extended_queries, feature_queries, model_queries, profile_queries

_MODULES = [profile_queries, feature_queries, model_queries, extended_queries]


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
