import os
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.sources import formats
from quarry.streaming import clusters, sketch


def write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_formats(spark, tmp_path):
    a = formats.adjacency(spark, write(tmp_path, "a", "1\t2,3,\n4\n5\t\n\n"))
    assert {r.user: r.friends for r in a.collect()} == {1: [2, 3], 4: [], 5: []}
    assert formats.adjacency_edges(a).count() == 2
    assert formats.edges(spark, write(tmp_path, "e", "1 2\n1\t2\n2  3\n")).count() == 2
    v = formats.numbered_vectors(spark, write(tmp_path, "v", "1 2\n\n3 4.5\n")).orderBy("id").collect()
    assert [r.v for r in v] == [[1, 2], [3, 4.5]] and [r.id for r in v] == [0, 1]
    assert formats.vectors(spark, write(tmp_path, "c", "1,2\n3,4\n"), ",").count() == 2
    b = formats.baskets(spark, write(tmp_path, "b", "x y x\n z \n"))
    assert sorted((r.basket, r.item) for r in b.collect()) == [(0, "x"), (0, "y"), (1, "z")]
    b = formats.csv_baskets(spark, write(tmp_path, "g", "whole milk, tea\n,rice ,\n"))
    assert sorted((r.basket, r.item) for r in b.collect()) == [(0, "tea"), (0, "whole milk"), (1, "rice")]
    n = formats.names(spark, write(tmp_path, "n", '"A B"\n"C"\n"C"\n'))
    assert sorted((r.i, r.name) for r in n.collect()) == [(0, "A B"), (1, "C"), (2, "C")]
    assert formats.ratings(spark, write(tmp_path, "r", "1 2 3.5\n")).first() == (0, 1, 3.5)
    u = formats.utility(spark, write(tmp_path, "u", "0 1\n1 1\n"))
    assert sorted((r.u, r.i) for r in u.collect()) == [(0, 1), (1, 0), (1, 1)]
    assert formats.integers(spark, write(tmp_path, "i", "5\n\n6\n")).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 3)], "letter string, n long")
    for _ in range(2):
        formats.write_pairs(df, str(tmp_path / "p"))
        formats.write_lines(df, str(tmp_path / "l"))
    assert [r.value for r in formats.lines(spark, str(tmp_path / "p")).collect()] == ["('a', 3)"]
    assert [r.value for r in formats.lines(spark, str(tmp_path / "l")).collect()] == ["a\t3"]


def test_streamed_sketch_equals_batch(spark, tmp_path):
    from quarry.operators import sketch as batch

    (tmp_path / "in").mkdir()
    for k in range(3):
        write(tmp_path / "in", f"{k}", "\n".join(str(i * k % 13) for i in range(40)))
    words = formats.integer_stream(spark, str(tmp_path / "in"))
    q = sketch.build_stream(words, 7).writeStream.outputMode("complete").format("memory").queryName("cms").start()
    q.processAllAvailable()
    q.stop()
    want = batch.build(formats.integers(spark, str(tmp_path / "in")), 7)
    assert sorted(map(tuple, spark.table("cms").collect())) == sorted(map(tuple, want.collect()))


def test_windowed_counts(spark, tmp_path):
    df = spark.range(20).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id") * 10)).alias("ts"), F.lit("x").alias("event_type"), F.col("id").cast("double").alias("value"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = sketch.windowed_counts(s).writeStream.outputMode("append").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert {r.n for r in spark.table("hours").collect()} == {6}


def test_stream_buckets():
    b = clusters.Buckets(4, 3, 1e9)
    for t in range(100):
        b.add(t, [float(t % 3), 0.0])
    sizes = [n for n, _, _ in b.full]
    assert all(sizes.count(s) <= 2 for s in sizes) and sum(sizes) + len(b.waiting) == 100
    found = b.query(10)
    assert 10 <= sum(n for _, n in found) <= 20 and len(found) <= 3
    again = clusters.Buckets(4, 3, 1e9).load(b.dump())
    assert again.query(10) == found
    late = clusters.Buckets(4, 3, 5)
    for t in range(100):
        late.add(t, [0.0])
    assert sum(n for n, _, _ in late.full) <= 16


def test_replayed_clusters(spark):
    x = np.random.default_rng(0).normal(size=(40, 2))
    df = spark.createDataFrame([("a", float(i), v.tolist()) for i, v in enumerate(x)], "key string, time double, v array<double>")
    assert clusters.replay_clusters(df, 4, 3, 1e9, 12).agg(F.sum("size")).first()[0] >= 12


def test_merge_is_exact_mean():
    assert clusters.merge_clusters([([0.0], 1), ([2.0], 3)], 1) == [(pytest.approx([1.5]), 4)]


def test_settled_tables_leave_nothing_else(spark):
    from quarry import storage

    folder = storage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    inner = lambda: storage.settled(lambda: storage.materialise(spark.range(5), "deep"), "inner")
    out = storage.settled(lambda: storage.materialise(spark.range(3)).join(inner(), "id"), "outer")
    assert sorted(r.id for r in out.collect()) == [0, 1, 2]
    assert [x.rpartition("-")[0] for x in set(os.listdir(folder)) - before] == ["outer"]


def test_a_cluster_needs_a_shared_folder():
    from quarry import storage

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError):
        storage.shared_dir(session)
