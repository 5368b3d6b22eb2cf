"""Name to (query, oracle SQL) of the library's own operators."""

from __future__ import annotations

from .plans import detect, sales, tables_io, text

_PARTS = [sales, text, detect, tables_io]
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
