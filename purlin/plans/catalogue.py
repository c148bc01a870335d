"""All queries of the engine's own operators, with the SQL each is checked against."""

from __future__ import annotations

from purlin.plans import answers, carbon, documents, files, graph, pages, retrieval, streams

_PARTS = (graph, carbon, retrieval, documents, answers, pages, files, streams)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
