"""All queries of the reconciliation operators and their SQL equivalents."""

from __future__ import annotations

from .operators import backfill, consensus, custody, deadlines, detectors, edits, gates, ingest, matching, readings, reports, scalars, sinks, views
from .sources import delimited, scans, statements

MODULES: tuple = (views, detectors, custody, deadlines, matching, gates, consensus, sinks, edits, ingest, backfill, statements, delimited, scans, scalars, readings, reports)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
