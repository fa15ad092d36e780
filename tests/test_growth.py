"""What a query moves, broadcasts and repeats as its tables grow, seen in its plans and on small cases."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from quarry.operators import graph, itemsets, learn, recommend, similarity, vector_search
from quarry.plans import models
from quarry.sources import formats


@pytest.fixture
def planned(monkeypatch):
    """The plans of all tables that a module's functions write."""

    def watch(module):
        plans, write = [], module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *a))[1])
        return plans

    return watch


@pytest.fixture
def ring(spark):
    return spark.range(1, 51).selectExpr("id src", "id % 50 + 1 dst").union(spark.range(2, 51).selectExpr("id src", "1L dst"))


@pytest.mark.parametrize("run", [graph.hits, graph.pagerank])
def test_link_analysis_broadcasts_no_table(ring, planned, run):
    plans = planned(graph)
    run(ring, iterations=9).collect()
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


@pytest.mark.parametrize("run", [graph.hits, graph.pagerank])
def test_a_step_shuffles_only_what_arrives(ring, planned, run):
    plans = planned(graph)
    run(ring, iterations=8).collect()
    deep = max(plans, key=len).split("InMemoryRelation")[0]
    assert deep.count("Exchange") <= 17


@pytest.fixture
def bought(spark):
    rows = [(b, f"i{(b * p + p) % 11:02}") for b in range(60) for p in range(1, 5)]
    return spark.createDataFrame(sorted(set(rows)), "basket long, item string")


@pytest.mark.parametrize("run", [lambda b: itemsets.toivonen(b, 0.05, 0.6, 0.5)[0], lambda b: itemsets.son(b, 0.05)[1], lambda b: itemsets.apriori(b, 4)[0]])
def test_mining_joins_no_baskets(bought, planned, run):
    plans = planned(itemsets)
    run(bought).collect()
    assert any("Generate posexplode" in p for p in plans)
    assert not any("basket#" in line.split("Join")[1] for p in plans for line in p.splitlines() if "Join" in line)


def test_mining_equals_brute_force_over_several_cuts(bought, monkeypatch):
    monkeypatch.setattr(itemsets, "CUT_LEVELS", 1)
    monkeypatch.setattr(itemsets, "BROADCAST_SETS", 0)
    held = {}
    for r in bought.collect():
        held.setdefault(r.basket, []).append(r.item)
    counts = Counter(c for items in held.values() for k in range(1, 5) for c in combinations(sorted(items), k))
    want = {s: c for s, c in counts.items() if c >= 4}
    for found in (itemsets.apriori(bought, 4)[0], itemsets.son(bought, 4 / 60, 3)[0], itemsets.count_itemsets(bought, itemsets.apriori(bought, 4)[0])):
        assert {tuple(r.itemset): r["count"] for r in found.collect()} == want


@pytest.fixture
def cloud(spark):
    r = random.Random(1)
    return spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(4)] if i % 9 else [0.5] * 4) for i in range(70)], "id long, v array<double>")


def test_vector_searches_meet_in_blocks_with_right_results(spark, cloud, monkeypatch):
    for name, size in {"QUERY_BLOCK": 3, "ROW_BLOCK": 10, "PAIR_QUERIES": 4, "PAIR_ROWS": 9, "TILE_QUERIES": 2, "TILE_ROWS": 4}.items():
        monkeypatch.setattr(vector_search, name, size)
    v, q = {r.id: r.v for r in cloud.collect()}, spark.range(0, 70, 9).toDF("q")
    hashed = vector_search.keys(cloud, vector_search.hash_functions(3, 2, 4, -0.5, 0.5))
    own, kept = {}, {}
    for r in hashed.collect():
        own.setdefault(r.id, set()).add((r.l, r.key))
    far = {(a, b): sum(abs(x - y) for x, y in zip(v[a], v[b], strict=True)) for a in range(0, 70, 9) for b in v if a != b}
    near = {p for p in far if own[p[0]] & own[p[1]]}
    for n, pairs in enumerate((far, near)):
        for a in range(0, 70, 9):
            for rank, (d, b) in enumerate(sorted((far[p], p[1]) for p in pairs if p[0] == a)[:3], 1):
                kept[n, a, b] = (d, rank)
    got = vector_search.searches(cloud, [None, hashed], q, 3)
    assert {(r.n, r.q, r.id): (r.dist, r["rank"]) for r in got.collect()} == kept
    assert sorted(map(tuple, vector_search.candidates(hashed, q).collect())) == sorted(near)
    every = vector_search.distances(cloud, q, 8)
    assert {(r.q, r.id): r.dist for r in every.collect()} == {p: round(d, 8) for p, d in far.items()}
    assert "Window" not in every._jdf.queryExecution().executedPlan().toString()


def test_waves_keep_the_order_of_each_user_and_item():
    r = random.Random(2)
    pairs = sorted({(r.randrange(40), r.randrange(15)) for _ in range(300)})
    us, its = np.array(pairs).T
    order, cuts = recommend.waves(us, its)
    assert sorted(order) == list(range(len(us))) and len(cuts) - 1 < len(us) / 3
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        assert len(set(us[order[a:b]])) == len(set(its[order[a:b]])) == b - a
    for ids in (us, its):
        for x in set(ids):
            assert list(order[ids[order] == x]) == sorted(order[ids[order] == x])


def test_texts_are_read_once_and_not_shuffled(spark, monkeypatch):
    plans, write = [], models.materialise
    monkeypatch.setattr(models, "materialise", lambda df, *a: (plans.append(df), write(df, *a))[1])
    rows = models.svm_features(spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "regexp_replace" not in rows._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" in plans[0]._jdf.queryExecution().optimizedPlan().toString()


def test_a_descent_is_compiled(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 1.0)], "x array<double>, y double")
    assert "aggregate(" not in learn.svm_cost(rows, [0.5, -0.5], 0.1)._jdf.queryExecution().executedPlan().toString()
    assert learn.svm_cost(rows, [0.5, -0.5], 0.1).first().cost == 0.25 + 100 * (1 - (0.5 - 1.0 + 0.1))


def test_character_shingles_are_counted_in_their_row(spark):
    texts = ["abcabcabcabc", "ab", "", None, "  A  b\nC d e", "a😀b😀a😀b😀a", "é" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = similarity.char_shingle_counts(docs)
    assert "explode" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.n for r in found.collect()} == {0: 3, 1: 1, 4: 5, 5: 4, 6: 1}


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    for n in range(3):  # the last file is the largest, which Spark reads first
        (tmp_path / f"part-{n}.txt").write_text("".join(f"i{n}-{k}{'x' * 50 * n}\n" for k in range(5 + 40 * n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = {r.i: r.name.rstrip("x") for r in formats.names(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(f"i{n}-{k}" for n in range(3) for k in range(5 + 40 * n)))


def test_a_matrix_is_cut_at_its_ones(spark, tmp_path):
    (tmp_path / "m.txt").write_text("0 1 0 1\n\n1 1 1 1\n0 0 0 0\n 0  2.5\t0 0\n1\n")
    found = formats.utility(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(0, 1), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3), (3, 1), (4, 0)]


def test_pairs_of_friends_are_made_where_the_user_is(spark, ring, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 7)
    friends = graph.undirected(ring)
    near = {}
    for r in friends.collect():
        near.setdefault(r.user, set()).add(r.friend)
    want = set()
    for u in near:
        mutual = {c: len(near[u] & near[c]) for c in near if c != u and c not in near[u] and near[u] & near[c]}
        want |= {(u, c, mutual[c], n) for n, c in enumerate(sorted(mutual, key=lambda c: (-mutual[c], c))[:10], 1)}
    found = graph.recommendations(friends)
    assert set(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode(candidates")]
