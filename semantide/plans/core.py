"""All queries for the corpus, question, answer and statistics operators."""

from __future__ import annotations

from semantide.plans import Registry, connectors, programs, questions, relations, results, selections

REGISTRY = Registry()
for part in (programs, questions, relations, results, connectors, selections):
    for name, query in part.REGISTRY.queries.items():
        REGISTRY.query(name, part.REGISTRY.sql.get(name))(query)
