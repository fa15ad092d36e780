import base64
import hashlib
import math
import os
import random
import sys
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import corpus  # noqa: E402
from corpus import clashing, documents, prose, write, write_documents  # noqa: E402

from quarry.llm import annsearch, chat, chunkdedup, ctw, decontaminate, langid, mixing, neardup, shingles, toxicity, warc  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC)


# 1 benchmark decontamination


def test_fm_index_finds_what_scanning_finds():
    r = np.random.default_rng(0)
    for n in (5, 60, 400):
        ids = np.append(r.integers(1, 5, n), 0).astype(np.int32)
        order = decontaminate.suffix_order(ids, 6)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: ids[i:].tolist())
        index = decontaminate.FMIndex(ids, 6, every=3)
        for m in (1, 2, 4):
            p = r.integers(2, 6, (9, m)).astype(np.int32)
            lo, hi = index.search(p, np.full(9, m))
            for k in range(9):
                want = [i for i in range(n + 1 - m) if (ids[i : i + m] == p[k]).all()]
                assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def items(rows):
    r = random.Random(5)
    some = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    return [(1, " ".join(some[0].split()[3:20])), (2, " ".join(some[0].split()[10:14])), (3, " ".join(some[5].split()[-9:])), (10, some[0].upper()), (11, None), (12, ""), (None, some[3]), (13, prose(r, 9)), (1, some[7])]


def brute_hits(rows, bench):
    windows = {}
    for i, t in bench:
        if i is not None and t is not None:
            for k in decontaminate.item_windows(t.encode()):
                windows.setdefault(k, set()).add(str(i))
    out = {}
    for d, t, *_ in rows:
        w = decontaminate.words((t or "").encode())
        hit, found = set(), set()
        for k, names in windows.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit |= set(range(s, s + len(k)))
                    found |= names
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_words": 100}, {"block_windows": 1}, {"block_bytes": 1, "shard_words": 300}])
def test_decontamination_equals_brute_force(spark, options):
    rows = documents()
    bench = items(rows)
    found = decontaminate.annotate(clashing(frame(spark, rows)), spark.createDataFrame(bench, "item_id long, text string"), **options)
    got = {r.doc_id: (r.fm_words, sum(e - s for s, e in zip(r.fm_starts, r.fm_ends)), list(r.fm_items)) for r in found.collect()}
    assert got == brute_hits(rows, bench)


def test_decontamination_is_one_pass_whatever_the_blocks(spark):
    rows = documents()
    same = " ".join(rows[0][1].split()[:8])
    bench = [(i, same) for i in range(60)] + items(rows)  # one window of many items
    found = decontaminate.annotate(frame(spark, [*rows, *rows[:3]]), spark.createDataFrame(bench, "item_id long, text string"), block_windows=3, block_bytes=100)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = found.collect()
    want = brute_hits(rows, bench)
    assert len(got) == len(rows) + 3
    assert all((r.fm_words, sum(e - s for s, e in zip(r.fm_starts, r.fm_ends)), list(r.fm_items)) == want[r.doc_id] for r in got)


def test_decontamination_cuts_and_drops(spark):
    rows = documents()
    bench = items(rows)
    kept = {r.doc_id: r.text for r in decontaminate.clean(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    before = brute_hits(rows, bench)
    texts = {d: t for d, t, *_ in rows}
    assert set(kept) == {d for d, (_, _, f) in before.items() if len(f) < 2}
    assert all(kept[d] == texts[d] for d in kept if not before[d][2])
    assert all(len(decontaminate.words(kept[d].encode())) == before[d][0] - before[d][1] for d in kept if before[d][2])


def test_decontamination_cuts_what_a_cut_joins(spark):
    w = [f"w{i}" for i in range(30)]
    inner = " ".join(w[4:12])
    rows = [(1, " ".join(["a", *w[:4], inner, *w[4:12], "z"]), "en", "s", 0), (2, " ".join(["b", *w[:6], inner, *w[6:12]]), "en", "s", 0)]
    bench = spark.createDataFrame([(1, inner + " " + " ".join(w[12:15])), (1, " ".join(w[:12]))], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.clean(frame(spark, rows), bench).collect()}
    assert got[1].split() == ["a", "z"] and got[2].split() == ["b"]


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.annotate(frame(spark, []), none).count() == 0
    assert decontaminate.annotate(frame(spark, documents()), none).where(F.size("fm_items") > 0).count() == 0


# 2 mixing


def water(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in stopped)) / max(1, sum(w[s] for s in names if s not in stopped))
        more = {s for s in names if s not in stopped and w[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in stopped else w[s] * level for s in names}
        stopped |= more


def test_mixing_targets_and_copies(spark):
    rows = documents(n=60)
    plan = mixing.plan(clashing(frame(spark, rows))).collect()
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    for r in plan:
        assert r.mix_target == pytest.approx(want[r.source]) and r.mix_source_size == sizes[r.source]
        rate = r.mix_target / r.mix_source_size if r.mix_source_size else 0
        assert math.floor(rate) <= r.mix_copies <= min(3, math.ceil(rate))
    copies = {r.doc_id: r.mix_copies for r in plan}
    assert Counter(r.doc_id for r in mixing.mix(frame(spark, rows)).collect()) == Counter({d: n for d, n in copies.items() if n})
    assert mixing.plan(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [[(1, "a b", None, None, 0), (2, None, None, None, 0)], [(1, "", "en", "a", 0), (2, None, "en", "b", 0)], [(1, "a b c", "en", "a", 0), (2, "d", "en", "b", 0), (2, "d", "en", "b", 0), (3, "e f", "en", None, 0)]])
def test_mixing_of_few_documents(spark, rows):
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    plan = mixing.plan(frame(spark, rows)).collect()
    assert len(plan) == len(rows)
    for r in plan:
        assert r.mix_target == pytest.approx(want[r.source]) and 0 <= r.mix_copies <= 3
        assert sizes[r.source] or r.mix_copies == 0


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(1)
    rows = [(i, prose(r, r.randrange(5, 60)), "en", f"s{i % 4}" if i % 3 else "hot", 0) for i in range(4000)]
    plan = mixing.plan(frame(spark, rows)).groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("mix_size")).alias("t"), F.first("mix_target").alias("g")).collect()
    assert all(abs(x.t / x.g - 1) < 0.1 for x in plan)


# 3 near duplicates


def brute_components(rows):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(d, set()).update({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ())
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def test_near_duplicates_equal_brute_force(spark):
    rows = documents()
    r = random.Random(9)
    base = prose(r, 150).split()
    for i in range(100, 160):  # a chain of near copies
        base[r.randrange(len(base))] = f"w{i}"
        rows.append((i, " ".join(base), "en", "s", 0))
    rows += [(200 + i, prose(r, i), "en", "s", 0) for i in range(1, 7)] * 2
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.label(clashing(frame(spark, rows))).collect()}
    assert got == brute_components(rows)
    kept = [x.doc_id for x in neardup.distinct_documents(frame(spark, rows)).collect()]
    assert set(kept) == {d for d, (_, _, k) in got.items() if k}


def test_near_duplicates_in_split_regions(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 10)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 3)
    r = random.Random(2)
    base = prose(r, 120).split()
    rows = []
    for i in range(80):
        x = list(base)
        x[i] = f"w{i}"
        rows.append((i, " ".join(x), "en", "s", 0))
    rows += [(100 + i, prose(r, 90), "en", "s", 0) for i in range(30)]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.label(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_in_a_crowd_with_one_partner_each(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 6)
    monkeypatch.setattr(neardup, "NEIGHBOURS", 1)
    r = random.Random(4)
    base, rows = prose(r, 400), []
    for i in range(120):  # 0.84 to all others, 0.87 to its partner
        own = [f"own{i}x{j}" for j in range(8)]
        rows += [(2 * i + k, f"{base} {' '.join(own)} {' '.join(f'last{i}x{k}x{j}' for j in range(31))}", "en", "s", 0) for k in range(2)]
    want = brute_components(rows)
    assert {c for _, c, _ in want.values()} == set(range(0, 240, 2))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.label(frame(spark, rows)).collect()}
    assert got == want


def test_near_duplicates_in_a_large_crowd(spark):
    r = random.Random(14)
    base, rows, pairs = prose(r, 300), [], 1500
    for i in range(pairs):  # about 0.84 to all others, 0.87 to its partner
        own = " ".join(f"own{i}x{j}" for j in range(6))
        rows += [(2 * i + k, f"{base} {own} {' '.join(f'last{i}x{k}x{j}' for j in range(23))}", "en", "s", 0) for k in range(2)]
    want = brute_components([*rows[:4], *rows[-2:]])
    assert {c for _, c, _ in want.values()} == {0, 2, 2 * pairs - 2}
    got = {x.doc_id: x.component_id for x in neardup.label(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(2 * pairs)}


def test_near_duplicates_of_one_id_and_two_texts(spark):
    r = random.Random(15)
    x, y = prose(r, 60), prose(r, 60)
    rows = [(5, x, "en", "s", 0), (5, y, "en", "s", 0), (5, " ", "en", "s", 0), (7, x, "en", "s", 0), (8, y, "en", "s", 0)]
    seen = [sorted(map(tuple, neardup.label(frame(spark, some)).select("doc_id", "component_id").collect())) for some in (rows, rows[::-1])]
    assert seen[0] == seen[1] and seen[0] in ([(5, 5), (5, 5), (5, 5), (7, 5), (8, 8)], [(5, 5), (5, 5), (5, 5), (7, 7), (8, 5)])


def test_near_duplicates_at_another_similarity(spark):
    r = random.Random(16)
    w = prose(r, 100).split()
    rows = [(1, " ".join(w), "en", "s", 0), (2, " ".join([*w[:88], *(f"n{i}" for i in range(12))]), "en", "s", 0)]
    found = lambda percent: [x.component_id for x in neardup.label(frame(spark, rows), percent).collect()]
    assert sorted(found(85)) == [1, 2] and sorted(found(75)) == [1, 1]


def test_near_duplicates_without_ids_and_rows(spark):
    got = neardup.label(frame(spark, [(None, "a b c d e f", "en", "s", 0), (None, "a b c d e f", "en", "s", 0), (1, None, "en", "s", 0)])).collect()
    assert len(got) == 3 and all(x.kept for x in got)
    assert neardup.label(frame(spark, [])).count() == 0


def test_shingle_hashes_follow_the_words():
    texts = [b"A b  c\td e f", b"a B c d E F", b"a b", b"", b"b a"]
    a, b, c, d, e = shingles.shingle_sets(texts)
    assert a.tolist() == b.tolist() and len(a) == 2 and len(c) == 1 and len(d) == 0 and c.tolist() != e.tolist()


def test_few_duplicates_go_without_a_shuffle_of_texts(spark, monkeypatch):
    docs, key = frame(spark, documents()), "spark.sql.autoBroadcastJoinThreshold"
    limit = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        few = neardup.distinct_documents(docs)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
        many = neardup.distinct_documents(docs)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        kept = sorted(x.doc_id for x in few.collect())
        assert kept == sorted(x.doc_id for x in many.collect()) and 5 not in kept and 4 in kept
    finally:
        spark.conf.set(key, limit)


# 4 context-tree weighting


def reference_ctw(train, text, depth):
    """Sequential context-tree weighting with dicts, straight from the definition."""
    counts = {}

    def steps(s):
        data = ctw.END * depth + s
        for i in range(depth, len(data)):
            byte = data[i]
            for j in range(8):
                node = (1 << j) | (byte >> (8 - j))
                yield [(d, data[i - d : i][::-1], node) for d in range(depth + 1)], (byte >> (7 - j)) & 1

    for t in train:
        for path, bit in steps(ctw.stream(t)):
            for k in path:
                counts.setdefault(k, [0, 0])[bit] += 1
    kt = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(c) + 1)
    children = {}
    for d, ctx, node in counts:
        if d:
            children.setdefault((d - 1, ctx[:-1], node), []).append((d, ctx, node))
    weighted = {}
    for k in sorted(counts, key=lambda k: -k[0]):
        own = kt(counts[k])
        weighted[k] = own if k[0] == depth else math.log(0.5) + np.logaddexp(own, sum(weighted[c] for c in children.get(k, ())))
    bits = 0.0
    for path, bit in steps(ctw.stream(text)):
        p = None
        for k in reversed(path):
            c = counts.get(k, [0, 0])
            own = (c[bit] + 0.5) / (sum(c) + 1)
            if p is None:
                p = own
            else:
                stay = math.exp(kt(c) + math.log(0.5) - weighted[k]) if k in counts else 0.5
                p = stay * own + (1 - stay) * p
        bits += math.log2(p)
    return bits


def test_context_trees_equal_the_definition(spark):
    r = random.Random(4)
    rows = [(i, prose(r, r.randrange(3, 20)), "en", "s", 0) for i in range(12)] + [(12, None, "en", "s", 0), (13, "", "en", "s", 0), (14, "Zé zz", "en", "s", 0), (None, "x y", "en", "s", 0)]
    out = {x.doc_id: x for x in ctw.score(clashing(frame(spark, rows)).drop("held_out")).collect()}
    held = {d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1 for d, *_ in rows}
    train = [(t or "").encode() for d, t, *_ in rows if not held[d]]
    c = Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(c.values()), len(c)
    for d, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), None]
        assert (out[d].n_tokens, out[d].n_known, out[d].train_tokens, out[d].held_out) == (len(w), sum(c[x] > 0 for x in w), n, held[d])
        assert out[d].base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert out[d].score == pytest.approx(reference_ctw(train, (t or "").encode(), ctw.DEPTH) * math.log10(2), rel=2e-3)


def test_context_trees_over_several_blocks(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, prose(r, 60), "en", "s", 0) for i in range(40)]
    one = {x.doc_id: (x.score, x.base_score) for x in ctw.score(frame(spark, rows)).collect()}
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(ctw, "PART_BYTES", 3000)
    monkeypatch.setattr(ctw, "PIECE_BYTES", 700)
    many = {x.doc_id: (x.score, x.base_score) for x in ctw.score(frame(spark, rows).repartition(3)).collect()}
    assert all(np.allclose(one[d], many[d], rtol=1e-9) for d in one)
    assert ctw.score(frame(spark, [])).count() == 0


@pytest.mark.parametrize("fan", [5, 2])
def test_context_trees_over_several_levels(spark, monkeypatch, fan):
    r = random.Random(9)
    rows = [(i, prose(r, 60), "en", "s", 0) for i in range(60)]
    one = {x.doc_id: (x.score, x.base_score, x.n_known) for x in ctw.score(frame(spark, rows)).collect()}
    written, plain = [], ctw.materialise
    monkeypatch.setattr(ctw, "materialise", lambda df, name: written.append((name, plain(df, name))) or written[-1][1])
    for name, value in (("FAN", fan), ("BLOCK_BYTES", 1000), ("PART_BYTES", 2000), ("PIECE_BYTES", 700)):
        monkeypatch.setattr(ctw, name, value)
    many = {x.doc_id: (x.score, x.base_score, x.n_known) for x in ctw.score(frame(spark, rows).repartition(3)).collect()}
    assert all(np.allclose(one[d], many[d], rtol=1e-9) for d in one)
    asked = [t for name, t in written if name == "asked"]
    blocks = asked[0].where("kind is null").count()
    assert blocks > 10 and len(asked) > 1
    for t in asked:  # not blocks times parts
        assert t.where("kind is not null").count() <= 2 * fan * (blocks + fan ** len(asked))


def test_context_trees_of_long_and_repeated_texts(spark):
    r = random.Random(10)
    text = prose(r, 60_000)
    rows = [(1, text, "en", "s", 0), (1, text, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (5, text[:400], "en", "s", 0)]
    out = ctw.score(frame(spark, rows)).collect()
    assert sorted(x.doc_id for x in out) == [1, 1, 2, 2, 5]
    by = {d: [(x.score, x.base_score, x.n_tokens, x.n_known) for x in out if x.doc_id == d] for d in (1, 2, 5)}
    assert len(set(by[1])) == len(set(by[2])) == 1
    learned = sum(len(t.split()) + 1 for d, t, *_ in rows if zlib.crc32(str(d).encode()) % 5 != 1)
    assert {x.train_tokens for x in out} == {learned} and by[1][0][2] == len(text.split()) + 1


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 7.9, 8, 100, 1e6])
    assert np.allclose(ctw.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


# 5 toxicity


def labelled(seed=3, n=400):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        t = prose(r, r.randrange(20, 80)).split()
        for _ in range(4 if bad else 0):
            t[r.randrange(len(t))] = r.choice(["nasty", "vileness", "vilely", "scum"])
        docs.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    docs += [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    train = [x for x in labels if x[0] % 3] + [(1, 1), (None, 1), (2, None), (4, 7)]
    model = toxicity.fit(frame(spark, docs), spark.createDataFrame(train, "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(clashing(frame(spark, docs)), model, evidence=True).collect()}
    held = [(got[d].tox_score, y) for d, y in labels if d % 3 == 0]
    assert all((s >= toxicity.CUTOFF) == bool(y) for s, y in held)
    assert got[900].tox_score == got[901].tox_score < 0.2
    assert all(e.label == 1 for e in got[0].tox_evidence[:1])


@pytest.mark.parametrize("head", [0, 12, 1024])
def test_nearest_examples_are_exact(monkeypatch, head):
    monkeypatch.setattr(toxicity, "HEAD", head)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "GROUP", 7)
    r = np.random.default_rng(0)
    names = [f"t{i}".encode() for i in range(40)]
    texts = [b" ".join(r.choice(names, r.integers(0, 9))) for _ in range(300)]
    texts += texts[:20]  # ties
    vocabulary = toxicity.Vocabulary(np.unique(toxicity.term_hashes(names)[0][:, 0]))
    place = {w: int(vocabulary.find(toxicity.term_hashes([w])[0][:, 0])[0]) for w in names}
    assert sorted(place.values()) == list(range(40))
    df = r.integers(1, 200, 40).astype(float)
    ids, labels = r.permutation(len(texts)), (r.random(len(texts)) < 0.3).astype(int)
    model = toxicity.build(vocabulary, df, 300, ids, labels, vocabulary.count(texts)[1:], {0: 0.7, 1: 0.3})
    idf = np.log(301 / (df + 1)) + 1

    def unit(text):
        v = np.zeros(40)
        for w, n in Counter(text.split()).items():
            v[place[w]] = (1 + math.log(n)) * idf[place[w]]
        return v / (np.linalg.norm(v) or 1)

    flat = {int(i): unit(t) for i, t in zip(ids, texts)}
    asked = [b" ".join(r.choice(names, r.integers(0, 7))) for _ in range(50)] + [b""]
    _, query, term, count = vocabulary.count(asked)
    weights = model.weights(query, term, count, len(asked))
    for k in (1, 9, 60):
        found = list(model.nearest(query, term, weights, len(asked), k))
        less = list(model.nearest(query, term, weights, len(asked), k, np.array([int(p[0]) if len(p) else 0 for p, _ in found])))
        assert len(found) == len(asked)
        for text, (places, cos), (others, _) in zip(asked, found, less):
            q = unit(text)
            want = sorted(((-float(q @ v), i) for i, v in flat.items() if q @ v > 1e-9))[:k]
            assert np.allclose(cos, [-c for c, _ in want], atol=1e-5)
            assert all(math.isclose(q @ flat[int(model.ids[p])], c, abs_tol=1e-5) for p, c in zip(places, cos))
            assert not len(places) or places[0] not in others


def test_nearest_examples_take_the_postings_of_one_query_at_a_time(monkeypatch):
    monkeypatch.setattr(toxicity, "HEAD", 0)
    r = np.random.default_rng(1)
    names = [f"t{i}".encode() for i in range(300)]
    texts = [b" ".join(r.choice(names, 150)) for _ in range(600)]
    vocabulary = toxicity.Vocabulary(np.unique(toxicity.term_hashes(names)[0][:, 0]))
    labels = np.arange(len(texts)) % 2
    model = toxicity.build(vocabulary, np.full(300, 9.0), 300, np.arange(len(texts)), labels, vocabulary.count(texts)[1:], {0: 0.5, 1: 0.5})
    asked = [b" ".join(r.permutation(names)) for _ in range(toxicity.GROUP - 1)] + [b""]
    _, query, term, count = vocabulary.count(asked)
    weights = model.weights(query, term, count, len(asked))
    postings = int(np.diff(model.start)[term].sum())  # of the group
    tracemalloc.start()
    found = list(model.nearest(query, term, weights, len(asked), 9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert postings > 5_000_000 and peak < 2 * postings
    for i in (0, 50, len(asked) - 2, len(asked) - 1):  # as if asked alone
        own = query == i
        ((places, cos),) = model.nearest(query[own] - i, term[own], weights[own], 1, 9)
        assert places.tolist() == found[i][0].tolist() and cos.tolist() == found[i][1].tolist()


def test_counts_of_parts():
    texts = [b"a b c d e f g", b"", b"nothing here", b"longword longwords a"]
    vocabulary = toxicity.Vocabulary(np.unique(toxicity.term_hashes([b"a b c d e f g longword"])[0])[1:])
    text, part, term, n = vocabulary.count(texts, 3)
    assert text.tolist() == [0, 0, 0, 1, 2, 3] and np.bincount(part, n, 6).tolist() == [3, 2, 2, 0, 0, 6]
    whole = toxicity.joined(part, term, n, text, len(vocabulary))
    assert np.bincount(whole[0], whole[2]).tolist() == [7, 0, 0, 6] and sorted(whole[2][whole[0] == 3]) == [1, 1, 2, 2]


def test_toxicity_of_repeated_long_and_tied_texts(spark):
    docs, labels = labelled()
    long = "plain words " * 60_000
    docs += [(900, long + "scum nasty", "en", "s", 0), (901, long, "en", "s", 0), (0, docs[0][1], "en", "s", 0), (0, docs[0][1], "en", "s", 0)]
    docs += [(1000 + i, docs[5][1], "en", "s", 0) for i in range(200)]  # more equal examples than neighbours
    model = toxicity.fit(frame(spark, docs), spark.createDataFrame([*labels, *((1000 + i, 1) for i in range(200))], "doc_id long, toxic int"))
    out = toxicity.score(frame(spark, docs), model).collect()
    assert len({x.tox_score for x in out if x.doc_id == 0}) == 1 and sum(x.doc_id == 0 for x in out) == 3
    assert len({x.tox_score for x in out if x.doc_id >= 1000}) == 1 and all(0 <= x.tox_score <= 1 for x in out)


def test_toxicity_knows_rare_words_and_counts_all_documents(spark):
    docs, labels = labelled()
    odd = [f"odd{i}thing" for i in range(20)]
    docs += [(700, " ".join(odd), "en", "s", 0), (701, " ".join([*odd[:18], "new", "end"]), "en", "s", 0)]
    docs += [(800 + i, "odd0thing else", "en", "s", 0) for i in range(30)]
    model = toxicity.fit(frame(spark, docs), spark.createDataFrame([*labels, (700, 1)], "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(frame(spark, docs), model, evidence=True).collect()}
    assert got[701].tox_evidence[0].id == 700 and got[701].tox_evidence[0].cosine > 0.8
    idf = lambda w: model.idf[model.terms.find(toxicity.term_hashes([w])[0][:, 0])[0]]
    assert math.isclose(idf(b"odd0thing"), math.log((len(docs) + 1) / 33) + 1)
    assert math.isclose(idf(b"odd19thing"), math.log((len(docs) + 1) / 2) + 1)


def test_toxicity_without_usable_labels(spark):
    docs, _ = labelled(n=10)
    df = frame(spark, docs)
    for labels, want in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {x.tox_score for x in toxicity.score(df, model).collect()} == {want}
    assert toxicity.score(frame(spark, []), 0.0).count() == 0


# 6 nearest vectors


def test_nearest_vectors(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, []), (702, [0.0] * 16), (703, [float("nan")] + [1.0] * 15), (704, [None] + [1.0] * 15), (705, [1.0, 2.0]), (None, [1.0] * 16), (1, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = annsearch.nearest(clashing(df), F.col("vec_id") % 20 == 0).collect()
    recall = []
    for q in range(0, 600, 20):
        own = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len({v for _, v, _ in own} & set(np.argsort(-s)[:20].tolist())) / 20)
        assert len(own) == 20 and all(a[2] >= b[2] for a, b in zip(own, own[1:])) and q not in {v for _, v, _ in own}
        assert np.allclose([sc for _, _, sc in own], [x[v] @ x[q] for _, v, _ in own])
    assert np.mean(recall) >= 0.9
    assert not {g.vec_id for g in got} & {700, 701, 702, 703, 704, 705, None}


def test_few_vectors_and_ties(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (40, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, annsearch.nearest(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(20, 1, 2, 1.0), (20, 2, 3, 1.0), (20, 3, 40, 0.0), (40, 1, 2, 2.0), (40, 2, 3, 2.0), (40, 3, 20, 0.0)]
    assert annsearch.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_vector_search_stops_by_the_radius():
    r = np.random.default_rng(9)
    centres = r.normal(size=(40, 24))
    x = np.concatenate([c + 0.3 * r.normal(size=(100, 24)) for c in centres])
    block = annsearch.Block(np.arange(len(x)), x, (x * x).sum(1).max())
    queries = np.arange(0, len(x), 50)
    right = 0
    for i, found, _ in block.search(x[queries], queries):
        s = x @ x[queries[i]]
        s[queries[i]] = -np.inf
        right += len(set(found.tolist()) & set(np.argsort(-s)[:20].tolist()))
    assert right / len(queries) / 20 >= 0.9 and block.verified / len(queries) < 0.1 * len(x)


def test_repeated_vectors_and_queries(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0])] * 3 + [(i, [1.0, 1.0]) for i in (5, 5, 4)] + [(40, [1.0, 1e-3])], "vec_id long, embedding array<double>")
    got = Counter(map(tuple, annsearch.nearest(df, F.col("vec_id") == 20).collect()))
    assert got == Counter({(20, 1, 4, 1.0): 3, (20, 2, 5, 1.0): 3, (20, 3, 5, 1.0): 3, (20, 4, 40, 1.0): 3})


def test_vectors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(annsearch, "BLOCK_ROWS", 100)
    monkeypatch.setattr(annsearch, "QUERY_ROWS", 7)
    x = np.random.default_rng(6).normal(size=(500, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = annsearch.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 25 * 20 and len({(g.query_id, g.rank) for g in got}) == 500
    want = {q: set(np.argsort(-np.where(np.arange(500) == q, -np.inf, x @ x[q]))[:20].tolist()) for q in range(0, 500, 20)}
    assert np.mean([g.vec_id in want[g.query_id] for g in got]) >= 0.9


# 7 WARC


def pages(spark):
    big = "<html>" + "x" * 200
    rows = [(None, "v", big), (14, "w", "y" * 150), (14, "w", "y" * 150), (5, "http://a/\r\nb", big), (3, "http://c", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (7, "u", None), (8, "u", ""), (10, "ü", "é" * 60), (11, "u", "\x1f\x8b\x08" * 50), (12, "u", "a" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_archives_read_back_at_any_split(spark, split):
    df, rows = pages(spark)
    folder, files = warc.archive(clashing(df).repartition(2))
    every = warc.read(files, folder, split_bytes=split).collect()
    got = {r.page_id: r for r in every}
    assert Counter(r.page_id for r in every) == Counter(i for i, *_ in rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if i in (5, 9) else ("response", None))
        assert (r.payload, r.digest_valid) == ((None, None) if i in (5, 9) else (payload, True))


def test_reader_takes_records_of_any_digest_and_type(tmp_path):
    def member(kind, digest, body, more=()):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", *more, *([f"WARC-Payload-Digest: {digest}"] if digest else []), f"Content-Length: {len(body)}"]
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + c.flush()

    http, page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n", b"<p>page"
    sha1 = base64.b32encode(hashlib.sha1(page).digest()).decode()
    kind = ("Content-Type: application/http; msgtype=response",)
    parts = [member("warcinfo", None, b"software: x"), member("response", f"sha1:{sha1}", http + page, kind), member("response", None, http + page, kind), member("response", "sha256:00", http + page, kind), member("request", "odd:1", b"GET", kind)]
    data = b"".join(parts)
    (tmp_path / "x").write_bytes(data)
    with pa.OSFile(str(tmp_path / "x")) as f:
        got = list(warc.read_range(f, 0, len(data), len(data)))
    assert [(r["record_type"], r["digest_valid"]) for r in got] == [("warcinfo", None), ("response", True), ("response", None), ("response", False), ("request", None)]
    assert [r["payload"] for r in got[:4]] == [b"software: x", page, page, page] and got[1]["payload_digest"] == hashlib.sha256(page).hexdigest()
    assert {r["page_id"] for r in got} == {None} and {r["record_id"] for r in got} == {"<urn:uuid:1>"}


def test_reader_passes_false_magic_and_damage(tmp_path):
    good = [zlib.compressobj(6, zlib.DEFLATED, 31) for _ in range(3)]
    parts = [c.compress(warc.record(i, "u", b"p" * 50, hashlib.sha256(b"p" * 50).hexdigest(), None)) + c.flush() for i, c in enumerate(good)]
    data = b"\x1f\x8b\x08junk" + parts[0] + parts[1][:60] + warc.MAGIC + parts[2]
    (tmp_path / "x").write_bytes(data)
    with pa.OSFile(str(tmp_path / "x")) as f:
        assert [r["page_id"] for r in warc.read_range(f, 0, len(data), len(data))] == [0, 2]
        at = data.index(parts[2])
        assert [r["page_id"] for r in warc.read_range(f, at + 1, len(data), len(data))] == []
        assert [r["page_id"] for r in warc.read_range(f, 0, at, len(data))] == [0]


def test_empty_archive(spark):
    df, _ = pages(spark)
    folder, files = warc.archive(df.where("false"))
    assert warc.read(files, folder).count() == 0


# 8 language


def test_language_uses_all_evidence(spark):
    r = random.Random(0)
    talk = {"en": "the and ing tion with ough".split(), "fr": "les eaux que dans une oi".split()}
    text = lambda lang, n: " ".join("".join(r.choice(talk[lang]) for _ in range(2)) for _ in range(n))
    docs = spark.createDataFrame([(i, text(lang, 60), lang) for i in range(20) for lang in talk] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == ["en", "fr"]
    rows = [(i, f"http://h{i % 3}.example.{'fr' if i % 2 else 'com'}/", f'<html lang="{"fr" if i % 2 else "en"}"><script>{text("en", 9)}</script><p>{text("fr" if i % 2 else "en", 30)}</p>') for i in range(40)]
    rows += [(100, "http://h1.example.fr/x", ""), (101, None, None), (102, "bad url", "<html lang='fr'>"), (103, "http://u:p@H2.example.com:80/", "<p>" + text("fr", 30))]
    got = {x.page_id: x for x in langid.identify(clashing(spark.createDataFrame(rows, "page_id long, url string, html string")), model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang == ("fr" if i % 2 else "en") for i in range(40))
    assert got[100].lang == "fr" and got[100].text_lang is None  # by its address
    assert got[102].lang == "fr" and got[103].lang == "fr" and got[103].host == "h2.example.com"
    assert all(sum(x.posterior.values()) == pytest.approx(1) for x in got.values())


def test_language_without_labels_or_pages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    p = spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")
    assert langid.identify(p, langid.fit(docs)).first().lang is None
    model = langid.fit(spark.createDataFrame([("en", "the cat")], "lang string, text string"))
    assert langid.identify(p.where("false"), model).count() == 0


def test_visible_text():
    assert langid.visible(b"a<b>c</b><script>x<y</script>d<!-- e -->f<style>g").split() == [b"a", b"c", b"d", b"f"]
    assert langid.visible(b"p<!-- if x > 1 then <b>secret</b> words -->q<!-- <script> -->r<script><!-- </b> </SCRIPT >s<!--t").split() == [b"p", b"q", b"r", b"s"]


def brute_language(docs, rows):
    """The definition in plain Python: (language, probability, language of the text) by page."""

    def grams(text):
        low = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in b"  " + text + b"  ")
        low = [low[i : i + 3] for i in range(1, len(low) - 3)]
        return [((g[0] * 0x9E3779B1 & 0xFFFFFFFF ^ g[1] * 0x85EBCA77 & 0xFFFFFFFF ^ g[2] * 0xC2B2AE3D & 0xFFFFFFFF) >> 17) for g in low if g[:2] != b"  " and g[1:] != b"  "]

    counts = {}
    for _, t, lang in docs:
        if t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(t.encode()))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) for x in langs}
    weigh = lambda x, g: math.log((counts[x][g] + 0.5) / (total[x] + 0.5 * langid.BUCKETS))
    pages = []
    for i, url, html in rows:
        g = grams(langid.visible((html or "").encode()))
        e = [sum(weigh(x, v) - sum(weigh(y, v) for y in langs) / len(langs) for v in g) / 3 / math.sqrt(1 + len(g) / 400) for x in langs]
        host = (url or "").partition("://")[2].partition("/")[0].rpartition("@")[2].partition(":")[0].lower()
        said = langid.declared((html or "").encode())
        said = "none" if said is None else said if said in langs else "other"
        soft = [math.exp(x - max(e)) for x in e]
        pages.append((i, host, said, len(g), e, [x / sum(soft) for x in soft]))
    k = len(langs)
    add = lambda keep: [sum(p[5][i] for p in pages if keep(p)) for i in range(k)]
    of = add(lambda p: True)
    kinds = [*langs, "none", "other"]
    out = {}
    for i, host, said, n, e, own in pages:
        upper = [(x + 0.5) / (sum(of) + 0.5 * k) for x in of]
        for level in (-1, -2, None):
            cut = lambda h: ".".join(h.split(".")[level:])  # noqa: E731, B023
            mine = [max(a - b, 0) for a, b in zip(add(lambda p: cut(p[1]) == cut(host)), own)]  # noqa: B023
            upper = [(m + 4 * u) / (sum(mine) + 4) for m, u in zip(mine, upper)]
        told = add(lambda p: p[2] == said)  # noqa: B023
        logs = [e[j] + math.log((told[j] + 0.5) / (of[j] + 0.5 * len(kinds))) + math.log(upper[j]) for j in range(k)]
        soft = [math.exp(x - max(logs)) for x in logs]
        best = max(range(k), key=lambda j: soft[j])
        out[i] = (langs[best], soft[best] / sum(soft), langs[max(range(k), key=lambda j: own[j])] if n else None)  # noqa: B023
    return out


def test_language_equals_the_definition(spark):
    r = random.Random(3)
    talk = {"en": "the and ing tion".split(), "fr": "les eaux que oi".split(), "xx": "zz yy".split()}
    text = lambda lang, n: " ".join("".join(r.choice(talk[lang]) for _ in range(2)) for _ in range(n))
    docs = [(i, text(lang, 30), lang) for i in range(6) for lang in talk] + [(90, None, "en"), (91, "x", None)]
    rows = [(i, f"http://h{i % 4}.d{i % 2}.{r.choice(['com', 'fr'])}/", f'<html lang="{r.choice(["en", "fr", "q", "de"])}"><p>{text(r.choice(list(talk)), r.randrange(0, 4))}<!-- {text("xx", 5)} --><p>{text(r.choice(list(talk)), r.randrange(3))}') for i in range(30)]
    rows += [(50, None, None), (51, "no host", ""), (52, "http://h1.d1.fr/", text("fr", 900))]
    want = brute_language(docs, rows)
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame([*rows, *rows[:0]], "page_id long, url string, html string"), model).collect()
    for x in got:
        assert (x.lang, x.text_lang) == (want[x.page_id][0], want[x.page_id][2]) and x.probability == pytest.approx(want[x.page_id][1], rel=1e-6)


def test_language_of_repeated_pages_and_ties(spark):
    model = langid.fit(spark.createDataFrame([("b", "same text"), ("a", "same text")], "lang string, text string"))
    got = langid.identify(spark.createDataFrame([(1, "http://h.x/", "<p>same")] * 3, "page_id long, url string, html string"), model).collect()
    assert [(x.page_id, x.lang) for x in got] == [(1, "a")] * 3 and all(x.probability == pytest.approx(0.5) for x in got)


# 9 chat


def test_escaping_is_reversible():
    for t in ["", "<|im_end|>", "<!|x", "<!!|>", "<<|", "a<|b<!|c", "!|", "<"]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "answer <|im_end|> x"), (1, 0, "user", "q\nuestion"), (1, 2, "assistant", None), (2, 0, None, "é日本"), (2, None, "system", ""), (None, 0, "user", "lost"), (1, 1, "assistant", "answer <|im_end|> x"), (3, 0, "a\nb", "t" * 120_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(clashing(df))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).digest()))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.formatted(df.where("false"))).count() == 0


@pytest.mark.parametrize("size", [1, 7, 50])
def test_long_texts_have_the_ids_of_the_whole(monkeypatch, size):
    encoder, _, _ = chat._tokenizer(chat.VOCABULARY)
    r = random.Random(size)
    texts = ["".join(r.choice(["a", "bc", "'s", "'ll", "1", "23", " ", "  ", "\n", "\t", ".", "!?", "é", "日本", "。", "'", "<", "|", "\u3000", "\x1c"]) for _ in range(300)) for _ in range(60)]
    want = [encoder.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(chat, "SLICE", size)
    assert [chat.encode_text(encoder, t) for t in texts] == want


def test_masks_cover_the_assistant_only():
    ids, mask = chat.encode_turn("assistant", "<|im_end|><|im_start|>assistant ok")
    _, pieces, reserved = chat._tokenizer(chat.VOCABULARY)
    assert [int(i) for i in ids if i >= len(pieces)] == reserved
    assert chat.unescape(b"".join(pieces[i] for i in ids[mask]).decode()) == "<|im_end|><|im_start|>assistant ok"
    assert not chat.encode_turn("user", "x")[1].any()


# 10 substring dedup


def sequential_chunks(text):
    """The definition, byte by byte."""
    h, starts = 0, [0] if text else []
    hashes = []
    for i in range(len(text)):
        h = 0
        for b in text[max(0, i - chunkdedup.SPAN + 1) : i + 1]:
            h = ((h << 1) + int(chunkdedup.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    space = lambda b: b == 0x20 or 0x09 <= b <= 0x0D
    words = [i for i in range(len(text)) if not i or (space(text[i - 1]) and not space(text[i]))]
    again = {c for a, b, c in zip(words, words[1:], words[2:]) if text[a:b] == text[b:c]}
    for i in range(1, len(text)):
        if i in again:
            starts.append(i)
        elif i < chunkdedup.SPAN:
            continue
        elif (hashes[i - 1] < chunkdedup.CUT and space(text[i - 1]) and not space(text[i])) or (hashes[i - 1] < chunkdedup.RARE_CUT and text[i] & 0xC0 != 0x80):
            starts.append(i)
    out = []
    for a, b in zip(starts, [*starts[1:], len(text)]):
        while b - a > chunkdedup.MAX_CHUNK:
            c = next(x for x in range((len(out) and 0) + a + chunkdedup.MAX_CHUNK, b + 4) if x >= b or text[x] & 0xC0 != 0x80)
            if c >= b:
                break
            out.append((a, c))
            a = c
        out.append((a, b))
    return out


def test_chunks_equal_the_definition():
    r = random.Random(1)
    group = [prose(r, 60).encode(), b"", "é ß 日本語 ".encode() * 20, b"x" * 900, prose(r, 5).encode(), b"so so so and and " * 30 + b"the " * 50, b"the the a", b"a a b"]
    which, starts, ends, digest = chunkdedup.chunk_all(group)
    for i, t in enumerate(group):
        own = which == i
        assert list(zip(starts[own].tolist(), ends[own].tolist())) == sequential_chunks(t)
        for a, b in zip(starts[own], ends[own]):
            t[a:b].decode()
    same = {}
    for w, a, b, d in zip(which, starts, ends, digest):
        assert same.setdefault(int(d), group[w][a:b]) == group[w][a:b]


def test_chunks_do_not_depend_on_neighbours():
    r = random.Random(2)
    a, b = prose(r, 50).encode(), prose(r, 50).encode()
    alone = chunkdedup.chunk_all([b])
    after = chunkdedup.chunk_all([a, b])
    assert alone[1].tolist() == after[1][after[0] == 1].tolist() and alone[3].tolist() == after[3][after[0] == 1].tolist()


def test_repeated_passages_go_and_others_stay(spark):
    rows = documents()
    docs = {d: t for d, t, *_ in rows}
    got = {x.doc_id: x for x in chunkdedup.dedup(clashing(frame(spark, rows))).collect()}
    assert len(got) == len(rows)
    shared = set(docs[15].split()) & set(docs[16].split()) & set(docs[17].split())
    assert got[15].text == docs[15] and got[4].text == docs[4]  # the first of each keeps the passage
    for d in (16, 17):
        assert 300 < got[d].cdc_removed < len(docs[d].encode()) - 200 and shared
    assert all(got[d].text == "" for d in range(5, 9) if len(docs[4].split()) >= chunkdedup.MIN_WORDS)
    alone = set(docs) - set(range(4, 9)) - {10, 11, 12, 15, 16, 17, 28}
    assert all(got[d].text == docs[d] for d in alone)
    assert chunkdedup.dedup(frame(spark, [])).count() == 0


def brute_dedup(docs):
    """The definition in plain Python: text by document."""
    chunks = {d: [t[a:b] for a, b in sequential_chunks(t)] for d, t in docs.items()}
    keeper = {}
    for d in sorted(chunks):
        for c in chunks[d]:
            keeper.setdefault(c, d)
    out = {}
    for d, own in chunks.items():
        seen, left, run = set(), [], []
        for c in [*own, None]:
            again = c is not None and (keeper[c] != d or c in seen)
            seen.add(c)
            if again:
                run.append(c)
                continue
            if chunkdedup.size_in_words(b"".join(run)) < chunkdedup.MIN_WORDS:
                left += run
            run = []
            left.append(c or b"")
        out[d] = b"".join(left).decode()
    return out


def test_chunk_dedup_equals_the_definition(spark):
    r = random.Random(12)
    passage, line = prose(r, 90), prose(r, 25)
    wide = "".join(r.choice("日本語文章圏外漢字仮名交") for _ in range(900))
    rows = [[i, prose(r, r.randrange(5, 60)), "en", "s", 0] for i in range(24)]
    for i in range(3, 9):
        w = rows[i][1].split()
        rows[i][1] = " ".join([*w[:i], passage, *w[i:]])
    for i in range(9, 12):
        rows[i][1] += "\n" + line + "\n" + line
    rows[12][1] = rows[13][1] = "x" * 5000 + " " + rows[12][1]  # beyond forced cuts
    rows[14][1], rows[15][1] = "一" + wide, "二二二" + wide
    rows += [(24, passage * 40, "en", "s", 0), (2, rows[2][1], "en", "s", 0), (2, rows[2][1], "en", "s", 0)]  # a long text, rows repeated
    got = [(x.doc_id, x.text) for x in chunkdedup.dedup(frame(spark, rows)).collect()]
    want = brute_dedup({d: t.encode() for d, t, *_ in rows})
    assert len(got) == len(rows) and all(t == want[d] for d, t in got)
    assert len(want[15]) < 300 and len(want[24]) < len(passage) * 2


def test_chunk_dedup_resists_insertions(spark):
    r = random.Random(8)
    passage = prose(r, 300)
    rows = [(1, passage, "en", "s", 0), (2, "new " + passage[:700] + " inserted words " + passage[700:], "en", "s", 0), (None, passage, "en", "s", 0)]
    got = {x.doc_id: x for x in chunkdedup.dedup(frame(spark, rows)).collect()}
    assert got[2].cdc_removed > 0.8 * len(passage) and got[1].cdc_removed == 0 and got[None].text == passage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [f for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")]


def test_chunk_dedup_keeps_only_the_lists_while_texts_move(spark):
    on_disk = lambda: {f.getName() for f in shuffle_files(spark)}
    shared, before = spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), on_disk()
    tables = set(os.listdir(shared))
    out = chunkdedup.dedup(frame(spark, documents()))
    new = {x.partition("-")[0] for x in set(os.listdir(shared)) - tables}
    assert new == {"lists"}
    until = time.time() + 30
    while (left := on_disk() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert out.count() == out.count() == len(documents())


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = documents(n=50)
    write_documents(tmp_path, rows)
    write(tmp_path, "benchmark", items(rows), ["item_id", "text"], [pa.int64(), pa.string()])
    bad, labels = labelled(n=200)
    write(tmp_path, "labels", [(1000 + d, 1, y) for d, y in labels], ["doc_id", "quality", "toxic"], [pa.int64(), pa.int32(), pa.int32()])
    write_documents(tmp_path, rows + [(1000 + d, *x) for d, *x in bad])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "substring dedup", "benchmark decontamination", "mixing"]
    docs = clashing(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)))
        seen.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == clashing(spark.createDataFrame([], DOC)).columns
    assert not {1000 + d for d, y in labels if y} & set(seen[0]) and {1000 + d for d, y in labels if not y} <= set(seen[0])
    want = brute_components([(d, r.text) for d, r in seen[0].items()])
    assert set(seen[1]) == {d for d, (_, _, k) in want.items() if k}
    assert set(seen[2]) == set(seen[1]) and all(r.n_chars == len(r.text) for r in seen[2].values() if r.text is not None)
    hits = brute_hits([(d, r.text) for d, r in seen[2].items()], items(rows))
    assert set(seen[3]) == {d for d, (_, _, f) in hits.items() if len(f) < 2}
    assert all(n == 0 for _, n, _ in brute_hits([(d, r.text) for d, r in seen[3].items()], items(rows)).values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(1 for _ in docs.collect())
