"""Queries: clustering, recommendation, learning, sketches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quarry.functions.vectors import as_doubles
from quarry.operators import clustering as cl
from quarry.operators import learn
from quarry.operators import recommend as rec
from quarry.operators import sketch as sk
from quarry.operators import summaries as su
from quarry.operators.order import numbered, spread
from quarry.plans.tables import DIMS, RATINGS, UTILITY, WORDS, points, ratings, table, utility, words
from quarry.storage import materialise

K, ITERATIONS = 10, 20
USER, ITEMS = 99, 100
FACTORS, LAMBDA = 20, 0.1
#: Five rows of 10,000 buckets by the bounds e^-5 and e/10,000; and of few, so that words collide.
_, WIDE = sk.sizes(math.exp(-5), math.e * 1e-4)
NARROW = 271
#: Of each descent: step, stop rule, rows of a batch (None: all), and whether changes are averaged.
DESCENTS = {"svm_batch_costs": (3e-7, 0.25, None, False), "svm_minibatch_costs": (1e-5, 0.01, 20, True), "svm_stochastic_costs": (1e-4, 0.001, 1, True)}
#: Standardised text-shape features of labelled documents.
SHAPES = {"n_chars": None, "digits": "[^0-9]", "spaces": "[^ ]", "upper": "[^A-Z]", "punctuation": "[^.,;:!?]"}
W, B = [0.05, -0.1, 0.2, 0.0, 0.1], 0.5


def _start(spark, sf_dir):
    return cl.first_points(points(spark, sf_dir), K)


def _costs(spark, sf_dir, metric):
    costs, _ = cl.kmeans(points(spark, sf_dir), _start(spark, sf_dir), metric, ITERATIONS)
    return spark.createDataFrame([(i, round(c, 6)) for i, c in enumerate(costs)], "iteration int, cost double")


def _centroids(spark, sf_dir):
    _, last = cl.kmeans(points(spark, sf_dir), _start(spark, sf_dir), "l2", ITERATIONS)
    return spark.createDataFrame([(c, d, round(x, 6)) for c, v in enumerate(last) for d, x in enumerate(v)], "c int, d int, x double")


def _change(spark, sf_dir):
    out = [(m, round(cl.percentage_change(cl.kmeans(points(spark, sf_dir), _start(spark, sf_dir), m, 10)[0]), 6)) for m in ("l1", "l2")]
    return spark.createDataFrame(out, "metric string, percent double")


def _farthest(spark, sf_dir):
    ids, _ = cl.farthest_first(points(spark, sf_dir), K)
    return spark.createDataFrame(list(enumerate(ids)), "place int, id long")


def _assigned(spark, sf_dir):
    p = points(spark, sf_dir)
    return cl.assign(p, _start(spark, sf_dir)).select("id", "c").join(p, "id")


def _cure(spark, sf_dir):
    """Every fifth of the points by the hash of the id is the sample that CURE clusters; all points are assigned."""
    sample = _assigned(spark, sf_dir).where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 0)
    return cl.cure_assign(points(spark, sf_dir), cl.cure_representatives(sample))


def svm_features(spark, sf_dir):
    """(doc_id, x, y). Texts are read once, and what is counted in them is joined, not they."""
    n = F.length("text")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # runs of other characters are taken out at once, which leaves as many as one by one
    counted = docs.select("doc_id", *((n.cast("double") if not p else F.try_divide(F.length(F.regexp_replace("text", f"{p}+", "")), n)).alias(c) for c, p in SHAPES.items()))
    raw = materialise(counted.join(table(spark, sf_dir, "labels").select("doc_id", (2.0 * F.col("quality") - 1).alias("y")), "doc_id"), "features")
    facts = raw.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"{c}_f") for c in SHAPES))
    return raw.crossJoin(F.broadcast(facts)).select("doc_id", "y", F.array(*((F.col(c) - F.col(f"{c}_f.m")) / F.col(f"{c}_f.s") for c in SHAPES)).alias("x"))  # one row


def svm_rows(spark, sf_dir):
    """(place, x, y); places are a permutation by hash, so that slices are mini-batches."""
    shuffled = svm_features(spark, sf_dir).withColumn("h", F.md5(F.col("doc_id").cast("string").cast("binary")))
    return numbered(shuffled, ["h", "doc_id"], "place").select((F.col("place") - 1).alias("place"), "x", "y")


def _descent(spark, sf_dir, name):
    eta, epsilon, batch, averaged = DESCENTS[name]
    costs, _, _ = learn.descend(svm_rows(spark, sf_dir), len(SHAPES), eta, epsilon, batch_size=batch, averaged=averaged, most=None)
    return spark.createDataFrame([(i, round(c, 4)) for i, c in enumerate(costs)], "step int, cost double")


def _objective(spark, sf_dir):
    r = ratings(spark, sf_dir)
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    items = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("id"))
    f = rec.hashed_factors(items, FACTORS).select((-1 - F.col("id")).alias("id"), "f")
    return rec.objective(r, rec.hashed_factors(users, FACTORS), f, LAMBDA).select(F.round("error", 3).alias("error"))


def _estimates(spark, sf_dir, n):
    w = words(spark, sf_dir)
    return sk.estimate(w.select("word").distinct(), sk.build(w, n), n)


def _summary(spark, sf_dir):
    out = None
    for n in (NARROW, WIDE):
        s = sk.summary(sk.errors(words(spark, sf_dir), n)).select(F.lit(n).alias("buckets"), *(F.round(c, 8).alias(c) for c in ("median", "most", "under_one")))
        out = s if out is None else out.unionByName(s)
    return out


def _round(df, digits=8, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _gram(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(as_doubles(F.col("embedding")).alias("v"))


QUERIES = {
    "kmeans_assign": lambda s, d: _round(cl.assign(points(s, d), _start(s, d)), 8, "dist"),
    "kmeans_l2_costs": lambda s, d: _costs(s, d, "l2"),
    "kmeans_l1_costs": lambda s, d: _costs(s, d, "l1"),
    "kmeans_centroids": _centroids,
    "kmeans_pct_change": _change,
    "kmeans_farthest_init": _farthest,
    "kmeans_choose_k": lambda s, d: s.createDataFrame(sorted((k, round(v, 6), k == best) for best, seen in [cl.choose_k(points(s, d), 0.02)] for k, v in seen.items()), "k int, mean_distance double, chosen boolean"),
    "bfr_summary": lambda s, d: _round(cl.bfr_summary(_assigned(s, d)), 8, "sum", "sumsq"),
    "bfr_discard_set": lambda s, d: _round(cl.bfr_discard(points(s, d), cl.bfr_summary(_assigned(s, d))), 6, "distance"),
    "cure_assign": _cure,
    "bfr_clusters": lambda s, d: su.bfr(points(s, d), K)[1],
    "cure_clusters": lambda s, d: su.cure(points(s, d), K),
    "grgpf_clusters": lambda s, d: su.grgpf(points(s, d), 1.0),
    "clustroids": lambda s, d: _round(cl.clustroids(_assigned(s, d)), 6, "rowsum"),
    "cf_user_user_top5": lambda s, d: _round(rec.top_items(rec.user_user(utility(s, d), USER, ITEMS)), 8, "score"),
    "cf_item_item_top5": lambda s, d: _round(rec.top_items(rec.item_item(utility(s, d), USER, ITEMS)), 8, "score"),
    "mf_sgd_errors": lambda s, d: _round(rec.sgd_factors(ratings(s, d), FACTORS, LAMBDA, users=table(s, d, "customer").count(), items=table(s, d, "supplier").count()), 6, "error"),
    "mf_objective": _objective,
    "gram_matrix": lambda s, d: _round(learn.gram(_gram(s, d)), 8, "x"),
    "svd_singular_values": lambda s, d: _round(s.createDataFrame(learn.singular_values(_gram(s, d)), "rank int, singular_value double, eigenvalue double"), 6, "singular_value", "eigenvalue"),
    "svd_power_sums": lambda s, d: s.createDataFrame([(k, round(sum(e**k for _, _, e in found), 3)) for found in [learn.singular_values(_gram(s, d))] for k in range(1, 5)], "k int, power_sum double"),
    "svm_cost": lambda s, d: _round(learn.svm_cost(svm_features(s, d), W, B), 4, "cost"),
    "svm_gradient": lambda s, d: _round(learn.svm_gradient(svm_features(s, d), W, B), 4, "g"),
    **{name: lambda s, d, name=name: _descent(s, d, name) for name in DESCENTS},
    "cms_table": lambda s, d: sk.build(words(s, d), WIDE),
    "cms_estimate": lambda s, d: _estimates(s, d, NARROW),
    "cms_error": lambda s, d: _round(sk.errors(words(s, d), NARROW), 8, "error", "share"),
    "cms_error_summary": _summary,
}


def _kmeans_sql(metric: str, n: int) -> str:
    f = "abs(x - cx)" if metric == "l1" else "(x - cx) * (x - cx)"
    out = f"{DIMS}, first AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS c FROM points ORDER BY id LIMIT {K}), c0 AS (SELECT CAST(c AS INT) AS c, d, x AS cx FROM dims JOIN first USING (id))"
    for i in range(n):
        out += f""", a{i} AS MATERIALIZED (SELECT id, c, dist FROM (SELECT id, c, sum({f}) AS dist FROM dims JOIN c{i} USING (d) GROUP BY id, c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, c) = 1),
c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce(m, cx) AS cx FROM c{i} LEFT JOIN (SELECT c, d, avg(x) AS m FROM dims JOIN a{i} USING (id) GROUP BY 1, 2) USING (c, d))"""
    return out


def _costs_sql(metric: str, n: int) -> str:
    return f"WITH {_kmeans_sql(metric, n)} " + " UNION ALL ".join(f"SELECT {i} AS iteration, round(sum(dist), 6) AS cost FROM a{i}" for i in range(n))


def _farthest_sql() -> str:
    out = f"WITH {DIMS}, f0 AS (SELECT 0 AS place, 0::BIGINT AS id)"
    for i in range(1, K):
        out += f""", f{i} AS MATERIALIZED (SELECT * FROM f{i - 1} UNION ALL (SELECT {i}, id FROM (SELECT p.id, f.place, sum((p.x - q.x) * (p.x - q.x)) AS dist FROM dims p JOIN dims q ON p.d = q.d JOIN f{i - 1} f ON q.id = f.id GROUP BY 1, 2) GROUP BY id ORDER BY min(dist) DESC, id LIMIT 1))"""
    return out + f" SELECT place, id FROM f{K - 1}"


_ASSIGNED = _kmeans_sql("l2", 1)
_SUMMARY = _ASSIGNED + ", summary AS (SELECT c, CAST(d - 1 AS INT) AS d, count(*) AS n, sum(x) AS sum, sum(x * x) AS sumsq FROM dims JOIN a0 USING (id) GROUP BY c, d)"
_RAW = "raw AS (SELECT doc_id, 2.0::DOUBLE * quality - 1 AS y, " + ", ".join(f"length(text)::DOUBLE AS {c}" if not p else f"length(regexp_replace(text, '{p}', '', 'g')) / length(text) AS {c}" for c, p in SHAPES.items()) + " FROM documents JOIN labels USING (doc_id))"
_X = _RAW + ", xs AS (SELECT doc_id, y, -1 AS d, 1.0::DOUBLE AS x FROM raw" + "".join(f" UNION ALL SELECT doc_id, y, {i}, ({c} - (SELECT avg({c}) FROM raw)) / (SELECT stddev_pop({c}) FROM raw) FROM raw" for i, c in enumerate(SHAPES)) + ")"


def _svm(weights: str, i: int | str) -> str:
    """margins, cost and gradient for weights (d, w)."""
    return f""", m{i} AS MATERIALIZED (SELECT doc_id, any_value(y) * sum(x * w) AS m FROM xs JOIN {weights} USING (d) GROUP BY doc_id),
cost{i} AS (SELECT (SELECT coalesce(sum(w * w), 0) / 2 FROM {weights} WHERE d >= 0) + 100 * sum(greatest(0, 1 - m)) AS cost FROM m{i}),
g{i} AS MATERIALIZED (SELECT d, CASE WHEN d >= 0 THEN any_value(w) ELSE 0 END + 100 * coalesce(sum(-y * x) FILTER (WHERE m < 1), 0) AS g FROM xs JOIN m{i} USING (doc_id) JOIN {weights} USING (d) GROUP BY d)"""


_GIVEN = _X + ", w AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {v}::DOUBLE)" for i, v in [(-1, B), *enumerate(W)]) + ") t(d, w))" + _svm("w", "")


def _descent_sql(eta: float, epsilon: float, batch: int | None, averaged: bool) -> str:
    """A row per step by recursion: the gradient over the step's slice, the new weights, and then their cost over all rows."""
    dims = range(-1, len(SHAPES))  # -1 is the bias, whose feature is 1
    f = {d: "1.0::DOUBLE" if d < 0 else f"x{d}" for d in dims}
    margin = lambda w: "y * (" + " + ".join(f"{f[d]} * {w}{d + 1}" for d in dims) + ")"
    part = "" if batch is None else f" AND place // {batch} = step % ((SELECT count(*) FROM rows) // {batch} + CAST((SELECT count(*) FROM rows) % {batch} > 0 AS INT))"
    new = ", ".join(f"w{d + 1} - {eta!r}::DOUBLE * ({f'w{d + 1} + ' if d >= 0 else ''}100 * sum(CASE WHEN {margin('w')} < 1{part} THEN -y * {f[d]} ELSE 0 END)) AS v{d + 1}" for d in dims)
    ws, vs = (", ".join(f"{c}{d + 1}" for d in dims) for c in "wv")
    squares = " + ".join(f"v{d + 1} * v{d + 1}" for d in dims if d >= 0)
    change = "100 * abs(last - cost) / last"
    columns = "".join(f", ({c} - (SELECT avg({c}) FROM raw)) / (SELECT stddev_pop({c}) FROM raw) AS x{i}" for i, c in enumerate(SHAPES))
    return f"""WITH RECURSIVE {_RAW}, rows AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS place, y{columns} FROM raw),
d(step, cost, change, {ws}) AS (
  SELECT 0, 100.0::DOUBLE * count(*), {epsilon!r}::DOUBLE{", 0.0::DOUBLE" * len(dims)} FROM rows
  UNION ALL
  SELECT step + 1, cost, {f"(CASE WHEN step = 0 THEN 0 ELSE change END + {change}) / 2" if averaged else change}, {vs} FROM (
    SELECT step, last, change, {vs}, ({squares}) / 2 + 100 * sum(greatest(0, 1 - {margin("v")})) AS cost FROM (
      SELECT step, cost AS last, change, {new} FROM d, rows WHERE change >= {epsilon!r}::DOUBLE GROUP BY step, cost, change, {ws}), rows
    GROUP BY step, last, change, {vs}))
SELECT CAST(step AS INT) AS step, round(cost, 4) AS cost FROM d"""


_FACTOR = lambda key: "[" + ", ".join(f"('0x' || substr(md5(({key})::VARCHAR || ':{j}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * {(5 / FACTORS) ** 0.5!r}::DOUBLE" for j in range(1, FACTORS + 1)) + "]"
_CMS = lambda n: WORDS + f""", exact AS (SELECT word, count(*) AS f FROM words GROUP BY 1),
hashed AS (SELECT word, f, CAST(j AS INT) AS j, ((word % 123457) * a + b) % 123457 % {n} AS bucket FROM exact, (VALUES {", ".join(f"({j}, {a}, {b})" for j, (a, b) in enumerate(sk.HASH_PARAMS))}) p(j, a, b)),
sketch AS (SELECT j, bucket, CAST(sum(f) AS BIGINT) AS cnt FROM hashed GROUP BY 1, 2),
estimates AS (SELECT word, any_value(f) AS f, min(cnt) AS estimate FROM hashed JOIN sketch USING (j, bucket) GROUP BY 1),
errors AS (SELECT word, f, estimate, (estimate - f) / f AS error, f / sum(f) OVER () AS share FROM estimates)"""  # noqa: E731
_MEDIAN = "SELECT {n} AS buckets, round(median(error), 8) AS median, round(max(error), 8) AS most, round(avg(CAST(error < 1 AS DOUBLE)), 8) AS under_one FROM errors"

SQL = {
    "kmeans_assign": f"WITH {_ASSIGNED} SELECT id, c, round(dist, 8) AS dist FROM a0",
    "kmeans_l2_costs": _costs_sql("l2", ITERATIONS),
    "kmeans_l1_costs": _costs_sql("l1", ITERATIONS),
    "kmeans_centroids": f"WITH {_kmeans_sql('l2', ITERATIONS)} SELECT c, CAST(d - 1 AS INT) AS d, round(cx, 6) AS x FROM c{ITERATIONS}",
    "kmeans_pct_change": " UNION ALL ".join(f"(WITH {_kmeans_sql(m, 10)} SELECT '{m}' AS metric, round(100 * (a - b) / a, 6) AS percent FROM (SELECT (SELECT sum(dist) FROM a0) AS a, (SELECT sum(dist) FROM a9) AS b))" for m in ("l1", "l2")),
    "kmeans_farthest_init": _farthest_sql(),
    "bfr_summary": f"WITH {_SUMMARY} SELECT c, d, n, round(sum, 8) AS sum, round(sumsq, 8) AS sumsq FROM summary",
    "bfr_discard_set": f"WITH {_SUMMARY}, dist AS (SELECT id, c, sqrt(sum(power(x - sum / n, 2) / greatest(sumsq / n - power(sum / n, 2), 1e-12))) AS distance FROM dims JOIN summary s ON s.d = dims.d - 1 GROUP BY id, c) SELECT id, c, round(distance, 6) AS distance, distance < 4 * sqrt(64) AS discarded FROM dist QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, c) = 1",
    "clustroids": f"WITH {_ASSIGNED}, r AS (SELECT a.c, a.id, sum((p.x - q.x) * (p.x - q.x)) AS rowsum FROM a0 a JOIN a0 b ON a.c = b.c JOIN dims p ON p.id = a.id JOIN dims q ON q.id = b.id AND q.d = p.d GROUP BY 1, 2) SELECT c, id AS clustroid, round(rowsum, 6) AS rowsum FROM r QUALIFY row_number() OVER (PARTITION BY c ORDER BY round(rowsum, 9), id) = 1",
    "cf_user_user_top5": f"WITH {UTILITY}, p AS (SELECT u, 1 / sqrt(count(*)) AS p FROM utility GROUP BY 1), near AS (SELECT y.u, count(*) AS n FROM utility x JOIN utility y USING (i) WHERE x.u = {USER} GROUP BY 1), s AS (SELECT i, sum(n * p * (SELECT p FROM p WHERE u = {USER})) AS score FROM utility JOIN near USING (u) JOIN p USING (u) WHERE i <= {ITEMS} GROUP BY 1) SELECT i, round(score, 8) AS score FROM s ORDER BY round(s.score, 9) DESC, i LIMIT 5",
    "cf_item_item_top5": f"WITH {UTILITY}, q AS (SELECT i, 1 / sqrt(count(*)) AS q FROM utility GROUP BY 1), w AS (SELECT y.u, sum(q) AS w FROM utility x JOIN utility y USING (i) JOIN q USING (i) WHERE x.u = {USER} GROUP BY 1), s AS (SELECT i, sum(w) * any_value(q) AS score FROM utility JOIN w USING (u) JOIN q USING (i) WHERE i <= {ITEMS} GROUP BY 1) SELECT i, round(score, 8) AS score FROM s ORDER BY round(s.score, 9) DESC, i LIMIT 5",
    "mf_objective": f"""WITH {RATINGS}, p AS (SELECT c_custkey AS id, {_FACTOR('c_custkey')} AS f FROM customer), q AS (SELECT s_suppkey AS id, {_FACTOR('-1 - s_suppkey')} AS f FROM supplier), e AS (SELECT sum(power(rating - list_dot_product(p.f, q.f), 2)) AS e FROM ratings JOIN p ON p.id = "user" JOIN q ON q.id = item), w AS (SELECT sum(list_dot_product(f, f)) AS w FROM (FROM p UNION ALL FROM q)) SELECT round(e + {LAMBDA} * w, 3) AS error FROM e, w""",
    "gram_matrix": f"WITH {DIMS} SELECT CAST(p.d - 1 AS INT) AS i, CAST(q.d - 1 AS INT) AS j, round(sum(p.x * q.x), 8) AS x FROM dims p JOIN dims q ON p.id = q.id AND p.d <= q.d GROUP BY p.d, q.d",
    "svd_power_sums": f"WITH {DIMS}, g1 AS MATERIALIZED (SELECT p.d AS i, q.d AS j, sum(p.x * q.x) AS x FROM dims p JOIN dims q ON p.id = q.id GROUP BY 1, 2), g2 AS MATERIALIZED (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM g1 a JOIN g1 b ON a.j = b.i GROUP BY 1, 2) SELECT 1 AS k, round(sum(x), 3) AS power_sum FROM g1 WHERE i = j UNION ALL SELECT 2, round(sum(x), 3) FROM g2 WHERE i = j UNION ALL SELECT 3, round(sum(a.x * b.x), 3) FROM g1 a JOIN g2 b ON a.i = b.j AND a.j = b.i UNION ALL SELECT 4, round(sum(a.x * b.x), 3) FROM g2 a JOIN g2 b ON a.i = b.j AND a.j = b.i",
    "svm_cost": f"WITH {_GIVEN} SELECT round(cost, 4) AS cost FROM cost",
    "svm_gradient": f"WITH {_GIVEN} SELECT CAST(d AS INT) AS d, round(g, 4) AS g FROM g",
    **{name: _descent_sql(*options) for name, options in DESCENTS.items()},
    "cms_table": f"WITH {_CMS(WIDE)} SELECT * FROM sketch",
    "cms_estimate": f"WITH {_CMS(NARROW)} SELECT word, estimate FROM estimates",
    "cms_error": f"WITH {_CMS(NARROW)} SELECT word, f, estimate, round(error, 8) AS error, round(share, 8) AS share FROM errors",
    "cms_error_summary": " UNION ALL ".join(f"(WITH {_CMS(n)} {_MEDIAN.format(n=n)})" for n in (NARROW, WIDE)),
}
