"""All queries of the core, by name, with the SQL they are held against."""

from __future__ import annotations

from lectern.plans import claim_metrics, experiments, nested_records, portfolios, projections, ranking, records, relations, texts

_MODULES = [claim_metrics, nested_records, texts, ranking, portfolios, relations, projections, experiments, records]


def queries():
    return {name: f for m in _MODULES for name, f in m.queries().items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
