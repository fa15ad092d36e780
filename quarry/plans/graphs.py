"""Queries: token counts and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph, text
from quarry.plans.tables import EDGES, dead_end_edges, edges, table

#: Users of the report.
REPORT_USERS = [8, 24, 90, 99, 120, 131, 140, 142, 143, 149]


def _friends(spark, sf_dir):
    return graph.undirected(edges(spark, sf_dir))


def _rounded(df, *columns, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in columns})


QUERIES = {
    "letter_count": lambda s, d: text.initial_letter_counts(table(s, d, "documents")),
    "mutual_friends": lambda s, d: graph.mutual_friends(_friends(s, d)),
    "friend_recs": lambda s, d: graph.recommendations(_friends(s, d)),
    "friend_recs_report": lambda s, d: graph.recommendations(_friends(s, d), users=REPORT_USERS),
    "friend_recs_all_users": lambda s, d: graph.recommendation_lists(table(s, d, "customer").select((F.col("c_custkey") + 1).alias("user")), graph.recommendations(_friends(s, d))),
    "graph_stats": lambda s, d: graph.graph_stats(edges(s, d)),
    "pagerank": lambda s, d: _rounded(graph.pagerank(edges(s, d)), "score"),
    "pagerank_leaky": lambda s, d: _rounded(graph.pagerank(dead_end_edges(s, d)), "score"),
    "pagerank_top5": lambda s, d: _rounded(graph.top(graph.pagerank(edges(s, d))), "score"),
    "pagerank_bottom5": lambda s, d: _rounded(graph.bottom(graph.pagerank(edges(s, d))), "score"),
    "hits": lambda s, d: _rounded(graph.hits(edges(s, d)), "hub", "authority", digits=6),
}

_FRIENDS = EDGES + ', friends AS (SELECT src AS "user", dst AS friend FROM edges UNION SELECT dst, src FROM edges)'
_MUTUAL = _FRIENDS + """, pairs AS (
  SELECT x."user" AS a, y."user" AS b, count(*) AS mutual FROM friends x JOIN friends y ON x.friend = y.friend AND x."user" < y."user" GROUP BY 1, 2),
mutual AS (SELECT * FROM pairs WHERE NOT EXISTS (SELECT 1 FROM friends f WHERE f."user" = a AND f.friend = b))"""
_RECS = _MUTUAL + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY mutual DESC, candidate) AS rank
  FROM (SELECT a AS "user", b AS candidate, mutual FROM mutual UNION ALL SELECT b, a, mutual FROM mutual)),
recs AS (SELECT "user", candidate, mutual, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10)"""
_PAGERANK = """, n AS (SELECT greatest(max(src), max(dst)) AS n FROM edges),
nodes AS (SELECT unnest(range(1, n + 1)) AS node FROM n),
links AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM edges UNION ALL SELECT node, node, 0 FROM nodes),
ranks(step, node, score) AS (
  SELECT 0, node, 1.0::DOUBLE / n FROM nodes, n
  UNION ALL
  SELECT any_value(step) + 1, dst, 0.2::DOUBLE / any_value(n) + 0.8::DOUBLE * sum(score * w) FROM ranks JOIN links ON src = node, n WHERE step < 40 GROUP BY dst),
final AS (SELECT node, score FROM ranks WHERE step = 40)"""
_HITS = """, nodes AS (SELECT unnest(range(1, (SELECT greatest(max(src), max(dst)) FROM edges) + 1)) AS node),
fwd AS (SELECT src, dst, 1 AS w FROM edges UNION ALL SELECT node, node, 0 FROM nodes),
two AS (SELECT x.src AS a, y.src AS b, count(*) AS w FROM edges x JOIN edges y ON x.dst = y.dst GROUP BY 1, 2 UNION ALL SELECT node, node, 0 FROM nodes),
hubs(step, node, x) AS (
  SELECT 0, node, 1.0::DOUBLE FROM nodes
  UNION ALL
  SELECT step + 1, node, x / max(x) OVER () FROM (SELECT any_value(step) AS step, a AS node, CAST(sum(x * w) AS DOUBLE) AS x FROM hubs JOIN two ON b = node WHERE step < 40 GROUP BY a)),
h AS (SELECT node, x FROM hubs WHERE step = 40),
before AS (SELECT node, x FROM hubs WHERE step = 39),
a AS (SELECT dst AS node, CAST(sum(x * w) AS DOUBLE) AS x FROM before JOIN fwd ON src = node GROUP BY dst)
SELECT node, round(h.x, 6) AS hub, round(a.x / (SELECT max(x) FROM a), 6) AS authority FROM h JOIN a USING (node)"""
_DEAD = EDGES.replace("edges AS", "all_edges AS", 1) + ", edges AS (SELECT * FROM all_edges WHERE src % 10 <> 0)"

SQL = {
    "letter_count": "SELECT lower(w[1]) AS letter, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[^a-zA-Z]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1",
    "mutual_friends": f"WITH {_MUTUAL} SELECT * FROM mutual",
    "friend_recs": f"WITH {_RECS} SELECT * FROM recs",
    "friend_recs_report": f'WITH {_RECS} SELECT * FROM recs WHERE "user" IN ({", ".join(map(str, REPORT_USERS))})',
    "friend_recs_all_users": f"""WITH {_RECS} SELECT c_custkey + 1 AS "user", coalesce(l, '') AS candidates FROM customer LEFT JOIN (SELECT "user" AS u, string_agg(CAST(candidate AS VARCHAR), ',' ORDER BY rank) AS l FROM recs GROUP BY 1) ON u = c_custkey + 1""",
    "graph_stats": f"WITH {EDGES} SELECT greatest(max(src), max(dst)) AS nodes, count(*) AS edges FROM edges",
    "pagerank": f"WITH RECURSIVE {EDGES}{_PAGERANK} SELECT node, round(score, 8) AS score FROM final",
    "pagerank_leaky": f"WITH RECURSIVE {_DEAD}{_PAGERANK} SELECT node, round(score, 8) AS score FROM final",
    "pagerank_top5": f"WITH RECURSIVE {EDGES}{_PAGERANK} SELECT node, round(score, 8) AS score FROM final ORDER BY final.score DESC, node LIMIT 5",
    "pagerank_bottom5": f"WITH RECURSIVE {EDGES}{_PAGERANK} SELECT node, round(score, 8) AS score FROM final ORDER BY final.score, node DESC LIMIT 5",
    "hits": f"WITH RECURSIVE {EDGES}{_HITS}",
}
