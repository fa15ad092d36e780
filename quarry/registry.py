"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from quarry.plans import baskets, graphs, models, similarity, sources, streams

_FAMILIES = (graphs, baskets, similarity, models, streams, sources)
QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
SQL = {name: sql for family in _FAMILIES for name, sql in family.SQL.items()}
