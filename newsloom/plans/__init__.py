"""All queries of the news model: QUERIES by name, SQL of those SQL can express, COVERS their operators."""

from newsloom.plans import dedupes, ingest, items, statistics, texts

_ALL = [items, statistics, texts, dedupes, ingest]
QUERIES = {k: f for m in _ALL for k, f in m.catalog.queries.items()}
SQL = {k: s for m in _ALL for k, s in m.catalog.sql.items()}
COVERS = {k: c for m in _ALL for k, c in m.catalog.covers.items()}
