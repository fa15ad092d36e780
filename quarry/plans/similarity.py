"""Queries: similar documents and near vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarry.operators import similarity as sim
from quarry.operators import vector_search as vs
from quarry.plans.tables import POINTS, points, table
from quarry.storage import materialise

THRESHOLD, HASHES, WORDS = 0.8, 128, 5
BANDS, ROWS = sim.choose_bands(HASHES, THRESHOLD)
BITS, TABLES, DIMENSIONS, LOW, HIGH, K = 8, 10, 64, -0.3, 0.3, 3
#: Searches ask for every row whose id is divisible by this, against all rows.
EVERY = 50
FUNCTIONS = vs.hash_functions(BITS, TABLES, DIMENSIONS, LOW, HIGH)
#: Sets of functions that the robust search tries.
ATTEMPTS = 20
SWEEP = [(BITS, t) for t in (10, 12, 14, 16, 18, 20)] + [(b, TABLES) for b in (4, 6, 10, 12)]


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _sets(spark, sf_dir):
    return sim.shingles(_docs(spark, sf_dir), WORDS, word_level=True)


def _signatures(spark, sf_dir):
    return sim.minhash(_sets(spark, sf_dir).select("doc_id", sim.shingle_hash(F.col("shingle")).alias("h")), sim.hash_params(HASHES), _docs(spark, sf_dir))


def _joined(df):
    return df.select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


def _similar(spark, sf_dir, exact):
    return sim.find_similar(_docs(spark, sf_dir), THRESHOLD, HASHES, WORDS, word_level=True, exact=exact)


def _q(spark, sf_dir):
    return points(spark, sf_dir).where(F.col("id") % EVERY == 0).select(F.col("id").alias("q"))


def _hashed(v, bits=BITS, tables=TABLES):
    return vs.keys(v, vs.hash_functions(bits, tables, DIMENSIONS, LOW, HIGH))


def _found(spark, sf_dir):
    v = points(spark, sf_dir)
    return vs.lsh_search(v, _hashed(v), _q(spark, sf_dir), K)


def _errors(spark, sf_dir, tries):
    """(n, error) of each pair of bits and tables; the exact search and all tries meet the rows together."""
    v = points(spark, sf_dir)
    found = materialise(vs.searches(v, [None, *(_hashed(v, b, t) for b, t in tries)], _q(spark, sf_dir), K), "found")
    of = lambda n: found.where(F.col("n") == n)
    return [vs.error_measure(of(n), of(0)).select(F.round("error", 8).alias("error")) for n in range(1, len(tries) + 1)]


def _sweep(spark, sf_dir):
    out = [e.select(F.lit(b).alias("bits"), F.lit(t).alias("tables"), "error") for (b, t), e in zip(SWEEP, _errors(spark, sf_dir, SWEEP), strict=True)]
    return reduce(lambda a, e: a.unionByName(e), out)


def _rounded(df):
    return df.withColumn("dist", F.round("dist", 8))


QUERIES = {
    "shingle_counts": lambda s, d: _sets(s, d).groupBy("doc_id").agg(F.count("*").alias("n")),
    "char_shingle_counts": lambda s, d: sim.char_shingle_counts(_docs(s, d)),
    "minhash_signatures": lambda s, d: _joined(_signatures(s, d)),
    "choose_bands": lambda s, d: s.createDataFrame([(HASHES, t / 10, *sim.choose_bands(HASHES, t / 10)) for t in range(1, 10)], "n int, threshold double, bands int, rows int"),
    "detection_prob": lambda s, d: s.range(1, 11).select((F.col("id") / 10).alias("s")).withColumn("p", F.round(sim.detection_probability(F.col("s"), BANDS, ROWS), 8)),
    "lsh_candidates": lambda s, d: sim.candidate_pairs(_signatures(s, d), BANDS, ROWS),
    "jaccard_pairs": lambda s, d: sim.overlapping_pairs(_sets(s, d)),
    "similar_docs": lambda s, d: _similar(s, d, True),
    "similar_docs_estimated": lambda s, d: _similar(s, d, False),
    "l1_distances": lambda s, d: vs.distances(points(s, d), _q(s, d), 8),
    "vector_lsh_keys": lambda s, d: vs.keys(points(s, d), FUNCTIONS),
    "vector_lsh_candidates": lambda s, d: vs.candidates(vs.keys(points(s, d), FUNCTIONS), _q(s, d)),
    "vector_lsh_knn": lambda s, d: _rounded(_found(s, d)),
    "vector_exact_knn": lambda s, d: _rounded(vs.linear_search(points(s, d), _q(s, d), K)),
    "vector_lsh_knn_robust": lambda s, d: _rounded(vs.robust_search(points(s, d), _q(s, d), K, BITS, TABLES, DIMENSIONS, LOW, HIGH, ATTEMPTS)),
    "vector_lsh_error": lambda s, d: _errors(s, d, [(BITS, TABLES)])[0],
    "vector_lsh_sweep": _sweep,
}

_WORDS = r"""w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> ''),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1)"""
_SIGS = _WORDS + f""", h AS (SELECT doc_id, ('0x' || substr(md5(shingle), 1, 15))::BIGINT % {sim.PRIME} AS h FROM sets),
sigs AS (SELECT doc_id, [{", ".join(f"min((h * {a} + {b}) % {sim.PRIME})" for a, b in sim.hash_params(HASHES))}] AS signature FROM h GROUP BY 1 UNION ALL SELECT doc_id, list_resize([]::BIGINT[], {HASHES}, {sim.PRIME}) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sets))"""
_CANDIDATES = _SIGS + f""", bands AS (SELECT doc_id, band, array_to_string(signature[band * {ROWS} + 1:(band + 1) * {ROWS}], ',') AS key FROM sigs, (SELECT unnest(range({BANDS})) AS band)),
good AS (SELECT band, key FROM bands GROUP BY 1, 2 HAVING count(*) >= 2),
held AS (SELECT * FROM bands SEMI JOIN good USING (band, key)),
pairs AS (SELECT DISTINCT x.doc_id AS i, y.doc_id AS j FROM held x JOIN held y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id)"""
_OVERLAP = _WORDS + """, common AS (SELECT x.doc_id AS i, y.doc_id AS j, count(*) AS c FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
sims AS (SELECT i, j, c / (a.n + b.n - c) AS sim FROM common JOIN sizes a ON a.doc_id = i JOIN sizes b ON b.doc_id = j)"""
_L1 = POINTS + f""", q AS (SELECT id AS q, v AS qv FROM points WHERE id % {EVERY} = 0),
dists AS (SELECT q, id, list_sum(list_transform(list_zip(v, qv), lambda z: abs(z[1] - z[2]))) AS dist FROM points, q WHERE id <> q)"""


def _keys_sql(functions):
    bits = lambda table: " || ".join(f"CASE WHEN v[{d + 1}] >= {t!r}::DOUBLE THEN '1' ELSE '0' END" for d, t in table)
    return f"SELECT id, CAST(unnest(range({len(functions)})) AS INT) AS l, unnest([{', '.join(map(bits, functions))}]) AS key FROM points"


_CANDS = lambda f: f"keys AS ({_keys_sql(f)}), cands AS (SELECT DISTINCT x.id AS q, y.id FROM keys x JOIN keys y ON x.l = y.l AND x.key = y.key AND x.id <> y.id WHERE x.id IN (SELECT q FROM q))"
_TOP = f"SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY dist, id) AS INT) AS rank FROM {{}} QUALIFY rank <= {K}"
_KNN = f"{_L1}, {_CANDS(FUNCTIONS)}, found AS ({_TOP.format('(SELECT * FROM dists SEMI JOIN cands USING (q, id))')}), exact AS ({_TOP.format('dists')})"
_ERROR = "SELECT {extra} round(avg(a / b), 8) AS error FROM (SELECT q, sum(dist) AS a FROM {found} GROUP BY q) JOIN (SELECT q, sum(dist) AS b FROM exact GROUP BY q) USING (q)"


def _numbered(n: int, bits: int, tables: int, seed: int = 0) -> str:
    """The search by a set of functions, its tables named by a number."""
    cands = _CANDS(vs.hash_functions(bits, tables, DIMENSIONS, LOW, HIGH, seed)).replace("keys AS", f"keys{n} AS").replace("keys x", f"keys{n} x").replace("keys y", f"keys{n} y").replace("cands AS", f"cands{n} AS")
    return f", {cands}, found{n} AS ({_TOP.format(f'(SELECT * FROM dists SEMI JOIN cands{n} USING (q, id))')})"


_SWEEP = f"WITH {_L1}, exact AS ({_TOP.format('dists')})" + "".join(_numbered(n, b, t) for n, (b, t) in enumerate(SWEEP)) + " UNION ALL ".join(" " + _ERROR.format(extra=f"{b} AS bits, {t} AS tables,", found=f"found{n}") for n, (b, t) in enumerate(SWEEP))
_TRIES = " UNION ALL ".join(f"SELECT {n} AS n, * FROM found{n}" for n in range(ATTEMPTS))
_ROBUST = f"WITH {_L1}" + "".join(_numbered(n, BITS, TABLES, n) for n in range(ATTEMPTS)) + f", tries AS ({_TRIES}), first AS (SELECT min(n) AS n FROM (SELECT n FROM tries GROUP BY n HAVING count(*) = {K} * (SELECT count(*) FROM q))) SELECT q, id, round(dist, 8) AS dist, rank FROM tries SEMI JOIN first USING (n)"

SQL = {
    "shingle_counts": f"WITH {_WORDS} SELECT * FROM sizes",
    "char_shingle_counts": r"WITH t AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, count(DISTINCT substr(t, i, 5)) AS n FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 4, 1) + 1)) AS i FROM t WHERE t <> '') GROUP BY 1",
    "minhash_signatures": f"WITH {_SIGS} SELECT doc_id, array_to_string(signature, ',') AS signature FROM sigs",
    "choose_bands": f"WITH t AS (SELECT {HASHES} AS n, unnest(range(1, 10)) / 10 AS threshold), r AS (SELECT n, threshold, r, abs(power(1 / (n // r), 1 / r) - threshold) AS gap FROM t, (SELECT unnest(range(1, {HASHES + 1})) AS r)) SELECT n, threshold, CAST(n // arg_min(r, (gap, r)) AS INT) AS bands, CAST(arg_min(r, (gap, r)) AS INT) AS rows FROM r GROUP BY 1, 2",
    "detection_prob": f"SELECT s, round(1 - power(1 - power(s, {ROWS}), {BANDS}), 8) AS p FROM (SELECT unnest(range(1, 11)) / 10 AS s)",
    "lsh_candidates": f"WITH {_CANDIDATES} SELECT * FROM pairs",
    "jaccard_pairs": f"WITH {_OVERLAP} SELECT * FROM sims",
    "similar_docs": f"WITH {_CANDIDATES}, c AS (SELECT i, j, count(*) AS c FROM pairs JOIN sets x ON x.doc_id = i JOIN sets y ON y.doc_id = j AND y.shingle = x.shingle GROUP BY 1, 2) SELECT i, j, c / (a.n + b.n - c) AS sim FROM c JOIN sizes a ON a.doc_id = i JOIN sizes b ON b.doc_id = j WHERE c / (a.n + b.n - c) >= {THRESHOLD} UNION ALL SELECT i, j, 1 FROM pairs WHERE i NOT IN (SELECT doc_id FROM sets) AND j NOT IN (SELECT doc_id FROM sets)",
    "similar_docs_estimated": f"WITH {_CANDIDATES}, s AS (SELECT i, j, len(list_filter(list_zip(x.signature, y.signature), lambda z: z[1] = z[2])) / {HASHES} AS sim FROM pairs JOIN sigs x ON x.doc_id = i JOIN sigs y ON y.doc_id = j) SELECT * FROM s WHERE sim >= {THRESHOLD}",
    "l1_distances": f"WITH {_L1} SELECT q, id, round(dist, 8) AS dist FROM dists",
    "vector_lsh_keys": f"WITH {POINTS} {_keys_sql(FUNCTIONS)}",
    "vector_lsh_candidates": f"WITH {_L1}, {_CANDS(FUNCTIONS)} SELECT * FROM cands",
    "vector_lsh_knn": f"WITH {_KNN} SELECT q, id, round(dist, 8) AS dist, rank FROM found",
    "vector_exact_knn": f"WITH {_KNN} SELECT q, id, round(dist, 8) AS dist, rank FROM exact",
    "vector_lsh_error": f"WITH {_KNN} {_ERROR.format(extra='', found='found')}",
    "vector_lsh_knn_robust": _ROBUST,
    "vector_lsh_sweep": _SWEEP,
}
