"""Name to query, and name to DuckDB SQL."""

from __future__ import annotations

from . import lines, market, oracle, prose, queries, rules, sheets, views

QUERIES = queries.QUERIES | lines.QUERIES | rules.QUERIES | views.QUERIES | market.QUERIES | prose.QUERIES | sheets.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | lines.ORACLE_SQL | rules.oracle_sql(oracle._SNAP, oracle._LOTS) | views.oracle_sql(oracle._LOTS) | market.oracle_sql(oracle._LOTS, oracle._REQ) | prose.ORACLE_SQL | sheets.oracle_sql(oracle._LOTS)

__all__ = ["ORACLE_SQL", "QUERIES"]
