import numpy as np

from quarry.operators import summaries as s


def blobs(spark, seed=0, per=60):
    r = np.random.default_rng(seed)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    x = np.concatenate([r.normal(c, 0.5, size=(per, 2)) for c in centres])
    truth = np.repeat(range(3), per)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), truth


def agrees(frame, truth):
    got = {r.id: r.c for r in frame.collect()}
    assert len(got) == len(truth)
    names = [{got[i] for i in np.flatnonzero(truth == t)} for t in range(3)]
    return all(len(n) == 1 for n in names) and len(set.union(*names)) == 3


def test_bfr(spark):
    df, truth = blobs(spark)
    kept, assigned = s.bfr(df, 3, chunks=3)
    assert agrees(assigned, truth)
    assert sum(n for n, _, _ in kept.values()) == len(truth)


def test_cure(spark):
    df, truth = blobs(spark, 1)
    assert agrees(s.cure(df, 3, sample_size=60), truth)
    assert len({r.c for r in s.cure(df, 6, sample_size=60, merge_under=4.0).collect()}) == 3


def test_agglomerate():
    assert s.agglomerate(np.array([[0.0], [1], [10], [11.5], [30]]), 3).tolist() == [0, 0, 1, 1, 2]


def test_grgpf(spark):
    df, truth = blobs(spark, 2)
    assert agrees(s.grgpf(df, 3.0, sample_size=90), truth)


def test_grgpf_inserts_all_points(spark, monkeypatch):
    df, truth = blobs(spark, 2)
    assert agrees(s.grgpf(df, 3.0, sample_size=1), truth)  # two groups have no point in the sample
    monkeypatch.setattr(s, "PART_POINTS", 10)
    monkeypatch.setattr(s, "TREES", 4)
    tree = s.grgpf_tree(df, 3.0, sample_size=1)
    assert sum(c.n for c in tree.clusters()) == len(truth)


def test_clustroid_estimates():
    d = lambda a, b: abs(a - b)
    c = s.ClustroidCluster([0.0, 1.0, 2.0], d, 4)
    assert c.clustroid == 1.0 and c.rowsum == 2.0
    c.insert(3.0)
    assert c.n == 4 and c.rowsum == 6.0
    t = s.ClustroidTree(d, 1.0, most=3, width=2)
    for x in range(40):
        t.insert(float(x))
    assert len(t.clusters()) <= 3 and sum(k.n for k in t.clusters()) >= 40
