"""Registered queries of the library, and their DuckDB twins."""

from __future__ import annotations

from . import blocks, lakehouse, network, study, synthetic

_PARTS = (lakehouse, study, network, blocks, synthetic)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
