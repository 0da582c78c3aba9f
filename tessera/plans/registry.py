"""All registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from tessera.operators import communities, containment, entities, extraction, graph, memory, notes, records, relational, resolution, retrieval, text_rules, wiki, windows
from tessera.sources import ingest
from tessera.streaming import events, runs

_PARTS = (communities, containment, retrieval, relational, records, memory, graph, entities, resolution, extraction, notes, ingest, text_rules, wiki, windows, events, runs)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
FLAGSHIP = "hybrid_retrieval"
