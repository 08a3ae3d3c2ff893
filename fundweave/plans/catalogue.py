"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from fundweave.plans import cases, evaluate, graph, intake, learn, streams

_PARTS = (intake, evaluate, graph, cases, streams, learn)

QUERIES = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLE_SQL = {k: q for part in _PARTS for k, q in part.ORACLE_SQL.items()}
