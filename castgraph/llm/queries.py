"""All queries of this folder, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from castgraph.llm import leaks, neighbours, pairs, pieces, severity, tokens

_MODULES = (neighbours, pieces, pairs, tokens, leaks, severity)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
