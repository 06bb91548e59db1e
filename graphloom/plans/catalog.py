"""All registered queries and their SQL."""

from __future__ import annotations

from graphloom.plans import building, notes, registry, reports  # noqa: F401  (modules register their queries when imported)

QUERIES, SQL, FLAGSHIP = registry.QUERIES, registry.SQL, registry.FLAGSHIP
