"""All queries by name, with the SQL that says the same."""

from __future__ import annotations

from caselode.plans import evaluation, exports, guard, metrics, retrieval, scanning, structure, texts

_PARTS = (metrics, texts, guard, structure, retrieval, scanning, evaluation, exports)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
