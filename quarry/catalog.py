"""All queries of the library, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from quarry.plans import access, corpus, graph, search, state

QUERIES = search.QUERIES | graph.QUERIES | state.QUERIES | corpus.QUERIES | access.QUERIES
ORACLES = search.ORACLES | graph.ORACLES | state.ORACLES | corpus.ORACLES | access.ORACLES
