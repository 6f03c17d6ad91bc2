"""All queries outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from . import analytics, auditing, checks, documents, mining, patching, runs

MODULES = [mining, auditing, analytics, patching, checks, runs, documents]
QUERIES = {k: v for m in MODULES for k, v in m.Q.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
