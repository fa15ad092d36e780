import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import clustering, graph, itemsets, learn, recommend, similarity, sketch, text, vector_search
from quarry.operators.order import numbered, with_next


def vectors(spark, rows):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(rows)], "id long, v array<double>")


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_letters(spark):
    docs = spark.createDataFrame([("The tea, a TIDE.",), ("",), (None,), ("9 x-ray",)], "text string")
    assert {r.letter: r.n for r in text.initial_letter_counts(docs).collect()} == {"t": 3, "a": 1, "x": 1, "r": 1}


def test_l1_distance_and_linear_search(spark):
    v = vectors(spark, [[1, 2, 3, 4], [2, 3, 2, 3]])
    q = spark.createDataFrame([(0,)], "q long")
    assert vector_search.linear_search(v, q, 1).first().dist == 4
    v = vectors(spark, [[0, 0], [1, 0], [5, 0], [0, 3]])
    assert [r.id for r in vector_search.linear_search(v, q, 2).orderBy("rank").collect()] == [1, 3]


def test_error_measure(spark):
    found = spark.createDataFrame([(0, 1, 2.0)], "q long, id long, dist double")
    best = spark.createDataFrame([(0, 2, 1.0)], "q long, id long, dist double")
    assert vector_search.error_measure(found, best).first().error == 2.0


def test_vector_keys_and_robust_search(spark):
    v = vectors(spark, [[0.1, 0.9], [0.1, 0.8], [0.9, 0.1]])
    k = vector_search.keys(v, [[(0, 0.5), (1, 0.9)]]).orderBy("id").collect()
    assert [r.key for r in k] == ["01", "00", "10"]
    q = spark.createDataFrame([(0,)], "q long")
    assert vector_search.robust_search(v, q, 1, 1, 4, 2, 0.0, 1.0).first().id == 1
    with pytest.raises(RuntimeError):
        vector_search.robust_search(v, q, 3, 1, 1, 2, 0.0, 1.0, max_attempts=2)


def test_friends(spark):
    friends = graph.undirected(edges(spark, [(1, 2), (1, 3), (4, 2), (4, 3), (2, 1), (5, 5)]))
    got = {(r.a, r.b): r.mutual for r in graph.mutual_friends(friends).collect()}
    assert got == {(2, 3): 2, (1, 4): 2}
    every = {(r.user, r.candidate, r.rank) for r in graph.recommendations(friends).collect()}
    assert every == {(2, 3, 1), (3, 2, 1), (1, 4, 1), (4, 1, 1)}
    assert {(r.user, r.candidate) for r in graph.recommendations(friends, users=[1, 2]).collect()} == {(1, 4), (2, 3)}
    lists = graph.recommendation_lists(spark.createDataFrame([(1,), (9,)], "user long"), graph.recommendations(friends))
    assert {r.user: r.candidates for r in lists.collect()} == {1: "4", 9: ""}


def test_pagerank_and_hits(spark):
    r = random.Random(1)
    pairs = sorted({(r.randrange(1, 21), r.randrange(1, 21)) for _ in range(80)})
    n = max(max(p) for p in pairs)
    link = np.zeros((n, n))
    for a, b in pairs:
        link[a - 1, b - 1] = 1
    out = link.sum(1)
    rank = np.full(n, 1 / n)
    for _ in range(12):
        rank = 0.2 / n + 0.8 * (rank / np.where(out, out, 1) * (out > 0)) @ link
    got = {x.node: x.score for x in graph.pagerank(edges(spark, pairs), iterations=12).collect()}
    assert np.allclose([got[i + 1] for i in range(n)], rank)
    kept = {x.node: x.score for x in graph.pagerank(edges(spark, [(1, 2)]), iterations=5, redistribute=True).collect()}
    assert sum(kept.values()) == pytest.approx(1)
    h = np.ones(n)
    for _ in range(12):
        a = link.T @ h
        a /= a.max()
        h = link @ a
        h /= h.max()
    got = {x.node: (x.hub, x.authority) for x in graph.hits(edges(spark, pairs), iterations=12).collect()}
    assert np.allclose([got[i + 1] for i in range(n)], np.stack([h, a], 1))


def baskets(spark, rows):
    return spark.createDataFrame([(i, x) for i, items in enumerate(rows) for x in items], "basket long, item string")


def counted(rows, least):
    out = {}
    for k in range(1, 6):
        for t in rows:
            for s in combinations(sorted(t), k):
                out[s] = out.get(s, 0) + 1
    return {s: n for s, n in out.items() if n >= least}


def as_dict(df):
    return {tuple(r.itemset): r["count"] for r in df.collect()}


def test_itemset_algorithms_agree(spark):
    r = random.Random(3)
    rows = [set(r.sample("abcdefg", r.randrange(1, 6))) for _ in range(120)]
    b, least = baskets(spark, rows), 0.1 * len(rows)
    want = counted(rows, least)
    found, levels = itemsets.apriori(b, least)
    assert as_dict(found) == want and levels[0][1] == 7
    two = {s: n for s, n in want.items() if len(s) <= 2}
    assert as_dict(itemsets.pcy(b, least, 7)[0]) == two
    assert as_dict(itemsets.multistage(b, least, 7, 5)[0]) == two
    assert as_dict(itemsets.son(b, 0.1, 4)[0]) == want
    got, tries = itemsets.toivonen(b, 0.1, fraction=0.6, lower=0.6)
    assert got is None or as_dict(got) == want
    assert tries
    items = itemsets.frequent_items(b, least)
    pairs = itemsets.frequent_pairs(b, least)
    assert {(x.a, x.b): x["count"] for x in pairs.collect()} == {s: n for s, n in want.items() if len(s) == 2}
    triples = itemsets.frequent_triples(b, pairs, least)
    assert {(x.a, x.b, x.c): x["count"] for x in triples.collect()} == {s: n for s, n in want.items() if len(s) == 3}
    rules = {(x.lhs, x.rhs): x.conf for x in itemsets.pair_rules(items, pairs).collect()}
    assert rules[("a", "b")] == pytest.approx(want[("a", "b")] / want[("a",)])
    border = {tuple(x.itemset) for x in itemsets.negative_border(found, b).collect()}
    assert not border & set(want)
    assert all(all(s in want for s in combinations(x, len(x) - 1)) for x in border if len(x) > 1)


def test_itemsets_of_empty_baskets(spark):
    b = baskets(spark, [])
    assert itemsets.apriori(b, 1)[0].count() == 0
    assert itemsets.pcy(b, 1)[0].count() == 0


def test_shingles(spark):
    docs = spark.createDataFrame([(0, "Ab  cDe"), (1, "ab"), (2, "  "), (3, None)], "doc_id long, text string")
    got = {}
    for r in similarity.shingles(docs, 5).collect():
        got.setdefault(r.doc_id, set()).add(r.shingle)
    assert got == {0: {"ab cd", "b cde"}, 1: {"ab"}}


def test_similar_documents(spark):
    texts = ["the cat sat on the mat today", "a dog ran in the park at noon", "the cat sat on the mat todax", "x", "", "the cat sat on the mat today"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.i, r.j): r.sim for r in similarity.find_similar(docs).collect()}
    assert got[(0, 5)] == 1.0 and (0, 1) not in got
    assert similarity.find_similar(docs, exact=False).where("i = 0 and j = 5").count() == 1
    sets = similarity.shingles(docs)
    pairs = spark.createDataFrame([(4, 4), (0, 2)], "i long, j long")
    assert {(r.i, r.j): r.sim for r in similarity.jaccard(pairs, sets).collect()}[(4, 4)] == 1.0


def test_bands(spark):
    assert similarity.choose_bands(128, 0.8) == (11, 11)
    p = spark.createDataFrame([(0.5,), (0.7,), (0.8,), (0.9,)], "s double").select(similarity.detection_probability(F.col("s"), 11, 11).alias("p"))
    assert [round(r.p, 3) for r in p.collect()] == [0.005, 0.197, 0.628, 0.984]


def test_kmeans_ties_and_empty_clusters(spark):
    p = vectors(spark, [[0, 0], [2, 0]])
    costs, c = clustering.kmeans(p, [[1, 0], [1, 0]], iterations=2)
    assert c == [[1, 0], [1, 0]] and costs == [2, 2]
    assert {r.c for r in clustering.assign(p, [[1, 0], [1, 0]]).collect()} == {0}


def test_choose_k_finds_planted_clusters(spark):
    r = random.Random(3)
    rows = [(i, [100.0 * (i % 21) + r.random(), *(r.random() for _ in range(9))]) for i in range(420)]
    best, seen = clustering.choose_k(spark.createDataFrame(rows, "id long, v array<double>"), 0.4)
    x = np.array([v for _, v in rows])
    assert best == 21 and {1, 2, 4, 8, 16, 32} <= set(seen)  # no largest k
    assert seen[1] == pytest.approx(np.linalg.norm(x - x.mean(0), axis=1).mean())
    assert seen[21] == pytest.approx(np.mean([np.linalg.norm(x[j::21] - x[j::21].mean(0), axis=1).mean() for j in range(21)]))
    assert clustering.choose_k(spark.createDataFrame([], "id long, v array<double>")) == (0, {})


def test_kmeans_costs_fall(spark):
    r = np.random.default_rng(0)
    p = vectors(spark, r.normal(size=(60, 3)))
    costs, _ = clustering.kmeans(p, clustering.first_points(p, 4), iterations=6)
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:]))
    assert clustering.percentage_change(costs, 5) > 0


def test_clustroid_and_summaries(spark):
    x = np.random.default_rng(1).normal(size=(30, 4))
    p = vectors(spark, x).withColumn("c", (F.col("id") % 2).cast("int"))
    for r in clustering.clustroids(p).collect():
        own = x[r.c :: 2]
        sums = ((own[:, None] - own[None]) ** 2).sum((1, 2))
        assert r.clustroid == r.c + 2 * int(sums.argmin()) and r.rowsum == pytest.approx(sums.min())
    summary = clustering.bfr_summary(p)
    assert summary.where("c = 0 and d = 1").first().sum == pytest.approx(x[::2, 1].sum())
    near = clustering.bfr_discard(vectors(spark, x), summary)
    assert near.count() == 30 and near.where("discarded").count() > 20
    reps = clustering.cure_representatives(p, 3)
    assert len(reps) == 6 and clustering.cure_assign(vectors(spark, x), reps).count() == 30


def test_svd(spark):
    m = spark.createDataFrame([([1.0, 2.0],), ([2.0, 1.0],), ([3.0, 4.0],), ([4.0, 3.0],)], "v array<double>")
    got = learn.singular_values(m)
    assert [round(s, 6) for _, s, _ in got] == [7.615773, 1.414214]
    assert [round(e, 6) for _, _, e in got] == [58.0, 2.0]


def test_collaborative_filtering(spark):
    r = (np.random.default_rng(2).random((8, 6)) < 0.5).astype(float)
    r[0, 0] = 1
    df = spark.createDataFrame([(int(u), int(i)) for u, i in zip(*np.nonzero(r))], "u long, i long")
    root = lambda d: np.divide(1, np.sqrt(d), out=np.zeros_like(d), where=d > 0)
    p, q = root(r.sum(1)), root(r.sum(0))
    uu = (p[:, None] * r @ r.T * p) @ r
    ii = r @ (q[:, None] * (r.T @ r) * q)
    for f, want in ((recommend.user_user, uu), (recommend.item_item, ii)):
        got = {x.i: x.score for x in f(df, 0).collect()}
        assert np.allclose([got.get(i, 0) for i in range(6)], want[0])


def test_full_buckets_keep_their_pairs(spark):
    rows = [(i, [7, 7, i // 6, 0]) for i in range(20)]  # all share the first band; six each are equal
    df = spark.createDataFrame(rows, "doc_id long, signature array<long>")
    got = sorted((r.i, r.j) for r in similarity.candidate_pairs(df, 2, 2, limit=3).collect())
    assert got == [(i, j) for i in range(20) for j in range(i + 1, 20)]


def test_sgd_factors(spark):
    rows = [(u, i, float(1 + (u * i) % 5)) for u in range(4) for i in range(5)]
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    got = [r.error for r in recommend.sgd_factors(df, k=3, epochs=3).orderBy("epoch").collect()]
    p, q = recommend.initial_factors(4, 3, 0, "users"), recommend.initial_factors(5, 3, 0, "items")
    for e in range(3):
        for u, i, x in rows:
            eps = 2 * (x - q[i] @ p[u])
            q[i], p[u] = q[i] + 0.02 * (eps * p[u] - 0.2 * q[i]), p[u] + 0.02 * (eps * q[i] - 0.2 * p[u])
        want = sum((x - q[i] @ p[u]) ** 2 for u, i, x in rows) + 0.1 * ((p**2).sum() + (q**2).sum())
        assert got[e] == pytest.approx(want)


def test_svm(spark):
    x = np.random.default_rng(4).normal(size=(30, 2))
    y = np.where(x[:, 0] > 0, 1.0, -1.0)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(30)], "place long, x array<double>, y double")
    w, b = np.array([0.3, -0.2]), 0.1
    m = y * (x @ w + b)
    assert learn.svm_cost(df, w.tolist(), b).first().cost == pytest.approx(w @ w / 2 + 100 * np.maximum(0, 1 - m).sum())
    g = {r.d: r.g for r in learn.svm_gradient(df, w.tolist(), b).collect()}
    bad = m < 1
    assert np.allclose([g[0], g[1]], w - 100 * (y[bad] @ x[bad])) and g[-1] == pytest.approx(-100 * y[bad].sum())
    costs, _, _ = learn.descend(df, 2, 1e-4, 0.25, most=5)
    assert costs[0] == 3000 and costs[-1] < costs[0]
    assert len(learn.descend(df, 2, 1e-4, 0.0001, batch_size=7, averaged=True, most=6)[0]) == 7


@pytest.mark.parametrize("size", [1, 7])
def test_descent_goes_on_to_its_stop_rule(spark, monkeypatch, size):
    r = np.random.default_rng(5)
    x = r.normal(size=(30, 2))
    y = np.where(x[:, 0] + r.normal(size=30) > 0, 1.0, -1.0)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(30)], "place long, x array<double>, y double").coalesce(1)
    w, b, change, want = np.zeros(2), 0.0, 0.0, [3000.0]
    while True:
        k = (len(want) - 1) % -(-30 // size) * size
        part = slice(k, k + size)
        bad = y[part] * (x[part] @ w + b) < 1
        w, b = w - 1e-4 * (w - 100 * (y[part][bad] @ x[part][bad])), b + 1e-4 * 100 * y[part][bad].sum()
        want.append(w @ w / 2 + 100 * np.maximum(0, 1 - y * (x @ w + b)).sum())
        change = (change + 100 * abs(want[-2] - want[-1]) / want[-2]) / 2
        if change < 0.2:
            break
    assert len(want) > 11
    assert learn.descend(df, 2, 1e-4, 0.2, batch_size=size, averaged=True, most=None)[0] == pytest.approx(want)
    monkeypatch.setattr(learn, "GUARD", 3)
    with pytest.raises(RuntimeError):
        learn.descend(df, 2, 1e-4, 0.2, batch_size=size, averaged=True, most=None)


def test_sketch(spark):
    assert sketch.sizes(math.exp(-5), math.e * 1e-4) == (5, 10_000)
    words = [i % 37 for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "word long")
    table = {}
    for w in words:
        for j, (a, b) in enumerate(sketch.HASH_PARAMS):
            k = (j, ((w % sketch.PRIME) * a + b) % sketch.PRIME % 11)
            table[k] = table.get(k, 0) + 1
    assert {(r.j, r.bucket): r.cnt for r in sketch.build(df, 11).collect()} == table
    assert all(r.estimate >= r.f for r in sketch.errors(df, 11).collect())


def test_numbered_and_next(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "k long, v long")
    got = numbered(df, ["k"], "n").orderBy("n").collect()
    assert [r.k for r in got] == list(range(50)) and [r.n for r in got] == list(range(1, 51))
    nxt = {r.k: r.after for r in with_next(df, ["k"], "k", "after").collect()}
    assert nxt[0] == 1 and nxt[49] is None
