"""Collects the queries and oracles of all plan modules."""

from __future__ import annotations

from paneloom.plans import analysis, audits, geography, measurement, population


def _modules() -> list:
    return [measurement, geography, population, analysis, audits]


def queries() -> dict:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
