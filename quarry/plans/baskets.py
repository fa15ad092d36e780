"""Queries: frequent itemsets and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import itemsets as it
from quarry.plans.tables import BASKETS, baskets

MIN_SUPPORT = 0.003
#: Absolute support of the rule queries.
MIN_COUNT = 40
#: At so low a support, a fifth of the baskets is too small a sample: no attempt would be proved complete.
TOIVONEN = {"fraction": 0.6, "lower": 0.5}
SET_SCHEMA = "itemset array<string>, size int, count long"


def _n(b) -> int:
    return it.basket_count(b)


def _apriori(spark, sf_dir, levels=False):
    b = baskets(spark, sf_dir)
    n = _n(b)
    found, stat = it.apriori(b, MIN_SUPPORT * n)
    return spark.createDataFrame(stat, "level int, candidates long, frequent long") if levels else it.with_support(found, n)


def _hashed(spark, sf_dir, run, stat=False):
    b = baskets(spark, sf_dir)
    n = _n(b)
    found, counts = run(b, MIN_SUPPORT * n, funnel=stat)
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts)) if stat else it.with_support(found, n)


def _son(spark, sf_dir, chunks=False):
    b = baskets(spark, sf_dir)
    found, stats = it.son(b, MIN_SUPPORT)
    return stats if chunks else it.with_support(found, _n(b))


def _toivonen(spark, sf_dir, attempts=False):
    b = baskets(spark, sf_dir)
    found, tries = it.toivonen(b, MIN_SUPPORT, **TOIVONEN)
    if attempts:
        return spark.createDataFrame(tries, "attempt int, factor double, sample long, sample_frequent long, border long, border_hits long")
    return it.with_support(found if found is not None else spark.createDataFrame([], SET_SCHEMA), _n(b))


def _border(spark, sf_dir):
    b = baskets(spark, sf_dir)
    found, _ = it.apriori(b, MIN_SUPPORT * _n(b))
    return it.negative_border(found, b).select(F.array_join("itemset", ",").alias("itemset"), "size")


def _rules(spark, sf_dir, triples):
    b = baskets(spark, sf_dir)
    items, pairs = it.frequent_items(b, MIN_COUNT), it.frequent_pairs(b, MIN_COUNT)
    return it.triple_rules(pairs, it.frequent_triples(b, pairs, MIN_COUNT)) if triples else it.pair_rules(items, pairs)


QUERIES = {
    "basket_profile": lambda s, d: it.profile(baskets(s, d)),
    "top_items": lambda s, d: it.top_items(baskets(s, d)),
    "itemsets_bruteforce_pairs": lambda s, d: it.brute_force_pairs(baskets(s, d)),
    "itemsets_apriori": _apriori,
    "apriori_levels": lambda s, d: _apriori(s, d, levels=True),
    "bruteforce_extrapolation": lambda s, d: it.extrapolated(baskets(s, d)),
    "frequent_items": lambda s, d: it.frequent_items(baskets(s, d), MIN_COUNT),
    "frequent_pairs": lambda s, d: it.frequent_pairs(baskets(s, d), MIN_COUNT),
    "frequent_triples": lambda s, d: it.frequent_triples(baskets(s, d), it.frequent_pairs(baskets(s, d), MIN_COUNT), MIN_COUNT),
    "pair_rules": lambda s, d: _rules(s, d, False),
    "triple_rules": lambda s, d: _rules(s, d, True),
    "pair_rules_top5": lambda s, d: it.top_rules(_rules(s, d, False)),
    "triple_rules_top5": lambda s, d: it.top_rules(_rules(s, d, True)),
    "itemsets_pcy": lambda s, d: _hashed(s, d, it.pcy),
    "pcy_funnel": lambda s, d: _hashed(s, d, it.pcy, stat=True),
    "pcy_bucket_sweep": lambda s, d: it.bucket_sweep(b := baskets(s, d), MIN_SUPPORT * _n(b)),
    "itemsets_multistage": lambda s, d: _hashed(s, d, it.multistage),
    "multistage_funnel": lambda s, d: _hashed(s, d, it.multistage, stat=True),
    "itemsets_son": _son,
    "son_chunks": lambda s, d: _son(s, d, chunks=True),
    "negative_border": _border,
    "itemsets_toivonen": _toivonen,
    "toivonen_attempts": lambda s, d: _toivonen(s, d, attempts=True),
}

_N = BASKETS + ", n AS (SELECT count(DISTINCT basket) AS n FROM baskets)"
_LETTERS = "abcdefg"
#: Orders have seven lines at most, and so baskets seven items.
_MOST = 7


def _sets(rows: str, k: int, extra: str = "") -> str:
    """All k-itemsets of each basket with their counts, as columns a, b, ..."""
    joins = "".join(f" JOIN {rows} x{i} ON x0.basket = x{i}.basket AND x{i - 1}.item < x{i}.item" for i in range(1, k))
    return f"SELECT {extra}{', '.join(f'x{i}.item AS {_LETTERS[i]}' for i in range(k))}, count(*) AS count FROM {rows} x0{joins} GROUP BY ALL"


def _comma(k: int) -> str:
    """The itemset's string."""
    return " || ',' || ".join(_LETTERS[:k])


_NAMES = dict(enumerate(("ones", "twos", "threes", "fours", "fives", "sixes", "sevens"), 1))
_SETS = _N + "".join(f", {name} AS ({_sets('baskets', k)})" for k, name in _NAMES.items()) + ", every AS (" + " UNION ALL ".join(f"SELECT {_comma(k)} AS itemset, {k} AS size, count FROM {name}" for k, name in _NAMES.items()) + """),
frequent AS (SELECT itemset, size, count, count / n AS support FROM every, n WHERE count >= 0.003::DOUBLE * n)"""
_FREQ = "SELECT itemset, CAST(size AS INT) AS size, count, support FROM frequent"
_F1 = "".join(f", f{k} AS (SELECT {', '.join(_LETTERS[:k])} FROM {name}, n WHERE count >= 0.003::DOUBLE * n)" for k, name in _NAMES.items())


def _joined(k: int) -> str:
    """Candidates of size k: two frequent sets that differ in the last item, with all other subsets frequent too."""
    stem, letters = _LETTERS[: k - 2], _LETTERS[:k]
    value = {c: f"x.{c}" for c in letters[:-1]} | {letters[-1]: f"y.{letters[-2]}"}
    semis = ""
    for drop in range(k - 2):
        kept = [c for i, c in enumerate(letters) if i != drop]
        semis += f" SEMI JOIN f{k - 1} z{drop} ON " + " AND ".join(f"z{drop}.{_LETTERS[i]} = {value[c]}" for i, c in enumerate(kept))
    on = " AND ".join([*(f"x.{c} = y.{c}" for c in stem), f"x.{letters[-2]} < y.{letters[-2]}"])
    return f"SELECT {', '.join(f'{v} AS {c}' for c, v in value.items())} FROM f{k - 1} x JOIN f{k - 1} y ON {on}{semis}"


_C = "".join(f", c{k} AS ({_joined(k)})" for k in range(2, _MOST + 1))
_ABS = BASKETS + f""", items AS (SELECT item, count(*) AS count FROM baskets GROUP BY 1 HAVING count(*) >= {MIN_COUNT}),
pairs AS (SELECT x.item AS a, y.item AS b, count(*) AS count FROM baskets x JOIN baskets y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= {MIN_COUNT}),
triples AS (SELECT x.item AS a, y.item AS b, z.item AS c, count(*) AS count FROM baskets x JOIN baskets y ON x.basket = y.basket AND x.item < y.item JOIN baskets z ON x.basket = z.basket AND y.item < z.item GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_COUNT}),
pair_rules AS (SELECT lhs, rhs, t / count AS conf FROM (SELECT a AS lhs, b AS rhs, count AS t FROM pairs UNION ALL SELECT b, a, count FROM pairs) JOIN items ON item = lhs),
triple_rules AS (SELECT r.a || ',' || r.b AS lhs, rhs, t / p.count AS conf FROM (SELECT a, b, c AS rhs, count AS t FROM triples UNION ALL SELECT a, c, b, count FROM triples UNION ALL SELECT b, c, a, count FROM triples) r JOIN pairs p ON p.a = r.a AND p.b = r.b)"""
_KEYS = _SETS + _F1 + """, ids AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS id, count(*) OVER () AS m FROM (SELECT DISTINCT item FROM baskets)),
keyed AS (SELECT t.a, t.b, x.id * x.m + y.id AS key, count FROM twos t JOIN ids x ON x.item = t.a JOIN ids y ON y.item = t.b),
b1 AS (SELECT key % 2000 AS bucket FROM keyed, n GROUP BY 1, n HAVING sum(count) >= 0.003::DOUBLE * n),
occurring AS (SELECT * FROM keyed WHERE a IN (FROM f1) AND b IN (FROM f1)),
after1 AS (SELECT * FROM occurring WHERE key % 2000 IN (FROM b1)),
b2 AS (SELECT (key * 7919) % 1999 AS bucket FROM after1, n GROUP BY 1, n HAVING sum(count) >= 0.003::DOUBLE * n),
after2 AS (SELECT * FROM after1 WHERE (key * 7919) % 1999 IN (FROM b2))"""
_CHUNKS = _N + """, places AS (SELECT basket, row_number() OVER (ORDER BY basket) AS place FROM (SELECT DISTINCT basket FROM baskets)),
c AS (SELECT CAST((place - 1) // CAST(ceil(n / 10) AS BIGINT) AS INT) AS chunk, basket, item FROM baskets JOIN places USING (basket), n),
sizes AS (SELECT chunk, count(DISTINCT basket) AS rows FROM c GROUP BY 1),
l AS (""" + " UNION ALL ".join(f"SELECT chunk, {k} AS size, count AS cnt FROM ({_sets('c', k, 'x0.chunk, ')})" for k in range(1, _MOST + 1)) + ")"


def _attempts(most: int = 6, decay: float = 0.8) -> str:
    """All attempts at a sample with its frequent sets and their border, up to the first whose border holds no frequent set."""
    border = "SELECT a AS itemset, count FROM ones WHERE a NOT IN (FROM f1)" + "".join(f" UNION ALL SELECT {_comma(k)}, coalesce(count, 0) FROM (FROM c{k} EXCEPT FROM f{k}) LEFT JOIN {_NAMES[k]} USING ({', '.join(_LETTERS[:k])})" for k in range(2, _MOST + 1))
    factor, tries = TOIVONEN["lower"], []
    for i in range(most):
        own = f"sample AS MATERIALIZED (SELECT * FROM baskets WHERE ('0x' || substr(md5('toivonen-{i}:' || basket), 1, 13))::BIGINT / {2.0**52} < {TOIVONEN['fraction']}), rows AS (SELECT count(DISTINCT basket) AS rows FROM sample)"
        own += "".join(f", f{k} AS MATERIALIZED (SELECT {', '.join(_LETTERS[:k])} FROM ({_sets('sample', k)}), rows WHERE count >= {factor!r}::DOUBLE * 0.003::DOUBLE * rows)" for k in _NAMES)
        found = " + ".join(f"(SELECT count(*) FROM f{k})" for k in _NAMES)
        tries.append(f"SELECT * FROM (WITH {own}{_C}, border AS ({border}) SELECT CAST({i + 1} AS INT) AS attempt, {factor!r}::DOUBLE AS factor, (FROM rows) AS sample, {found} AS sample_frequent, count(*) AS border, count(*) FILTER (border.count >= 0.003::DOUBLE * n) AS border_hits FROM border, n)")
        factor *= decay
    return f"WITH {_SETS}, tries AS MATERIALIZED ({' UNION ALL '.join(tries)}) SELECT * FROM tries WHERE attempt <= coalesce((SELECT min(attempt) FROM tries WHERE border_hits = 0), {most})"


SQL = {
    "basket_profile": f"WITH {BASKETS}, s AS (SELECT basket, count(*) AS size FROM baskets GROUP BY 1) SELECT count(*) AS baskets, CAST(sum(size) AS BIGINT) AS sold, min(size) AS min_size, avg(size) AS avg_size, max(size) AS max_size, (SELECT count(DISTINCT item) FROM baskets) AS items, avg(size) / (SELECT count(DISTINCT item) FROM baskets) AS density FROM s",
    "top_items": f"WITH {_N} SELECT item, count(*) AS count, count(*) / any_value(n) AS support FROM baskets, n GROUP BY item ORDER BY count DESC, item LIMIT 10",
    "itemsets_bruteforce_pairs": f"WITH {_SETS} SELECT x.a, y.a AS b, coalesce(t.count, 0) AS count FROM ones x JOIN ones y ON x.a < y.a LEFT JOIN twos t ON t.a = x.a AND t.b = y.a",
    "itemsets_apriori": f"WITH {_SETS} {_FREQ}",
    "apriori_levels": f"WITH {_SETS}{_F1}{_C}, l AS (SELECT 1 AS level, (SELECT count(*) FROM ones) AS candidates, (SELECT count(*) FROM f1) AS frequent{''.join(f' UNION ALL SELECT {k}, (SELECT count(*) FROM c{k}), (SELECT count(*) FROM f{k}) WHERE EXISTS (FROM f{k - 1})' for k in range(2, _MOST + 1))}) SELECT CAST(level AS INT) AS level, candidates, frequent FROM l",
    "bruteforce_extrapolation": f"WITH {_N}, m AS (SELECT count(DISTINCT item) AS m FROM baskets), c AS (SELECT CAST(k AS INT) AS k, CAST(round(factorial(CAST(m AS INT)) / factorial(CAST(k AS INT)) / factorial(CAST(m - k AS INT))) AS BIGINT) AS itemsets FROM m, (SELECT unnest(range(1, 7)) AS k)) SELECT k, itemsets, itemsets * n AS checks FROM c, n",
    "frequent_items": f"WITH {_ABS} SELECT * FROM items",
    "frequent_pairs": f"WITH {_ABS} SELECT * FROM pairs",
    "frequent_triples": f"WITH {_ABS} SELECT * FROM triples",
    "pair_rules": f"WITH {_ABS} SELECT * FROM pair_rules",
    "triple_rules": f"WITH {_ABS} SELECT * FROM triple_rules",
    "pair_rules_top5": f"WITH {_ABS} SELECT * FROM pair_rules ORDER BY conf DESC, lhs, rhs LIMIT 5",
    "triple_rules_top5": f"WITH {_ABS} SELECT * FROM triple_rules ORDER BY conf DESC, lhs, rhs LIMIT 5",
    "itemsets_pcy": f"WITH {_SETS} {_FREQ} WHERE size <= 2",
    "pcy_funnel": f"WITH {_KEYS} SELECT (SELECT CAST(sum(count) AS BIGINT) FROM keyed) AS hashed, (SELECT count(*) FROM b1) AS frequent_buckets, (SELECT count(*) FROM f1) AS frequent_items, (SELECT count(*) FROM occurring) AS occurring, (SELECT count(*) FROM after1) AS candidate_pairs",
    "pcy_bucket_sweep": f"WITH {_KEYS}, t AS (SELECT *, key % buckets AS bucket FROM keyed, (SELECT unnest([200, 2000, 20000, 200000]::BIGINT[]) AS buckets)), m AS (SELECT buckets, bucket FROM t, n GROUP BY buckets, bucket, n HAVING sum(count) >= 0.003::DOUBLE * n) SELECT buckets, count(DISTINCT m.bucket) / buckets AS frequent_share, count(*) AS candidates FROM m JOIN t USING (buckets, bucket) WHERE a IN (FROM f1) AND b IN (FROM f1) GROUP BY buckets",
    "itemsets_multistage": f"WITH {_SETS} {_FREQ} WHERE size <= 2",
    "multistage_funnel": f"WITH {_KEYS} SELECT (SELECT count(*) FROM b1) AS frequent1, (SELECT count(*) FROM b2) AS frequent2, (SELECT count(*) FROM after1) AS after1, (SELECT count(*) FROM after2) AS candidate_pairs",
    "itemsets_son": f"WITH {_SETS} {_FREQ}",
    "son_chunks": f"WITH {_CHUNKS} SELECT chunk, rows, count(*) AS local_frequent, CAST(max(size) AS INT) AS max_k FROM l JOIN sizes USING (chunk) WHERE cnt >= 0.003::DOUBLE * rows GROUP BY 1, 2",
    "negative_border": f"WITH {_SETS}{_F1}{_C} SELECT itemset, CAST(size AS INT) AS size FROM (SELECT a AS itemset, 1 AS size FROM ones WHERE a NOT IN (FROM f1){''.join(f' UNION ALL SELECT {_comma(k)}, {k} FROM (FROM c{k} EXCEPT FROM f{k})' for k in range(2, _MOST + 1))})",
    "itemsets_toivonen": f"WITH {_SETS} {_FREQ}",
    "toivonen_attempts": _attempts(),
}
