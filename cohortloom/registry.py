"""Registered queries of the study engine and their DuckDB oracles."""

from __future__ import annotations

from cohortloom.queries import analyses, cohorts, jobs, loading, records

MODULES = (cohorts, analyses, records, jobs, loading)
QUERIES: dict = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES: dict = {k: q for m in MODULES for k, q in m.ORACLES.items()}
