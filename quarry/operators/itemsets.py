"""Frequent itemsets and association rules over baskets (basket, item), distinct.

An itemset is an array of its items in order. Support tests are count >= min_count, where min_count may be a fraction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.order import numbered
from quarry.storage import materialise

#: A bitmap of so many buckets at most (8 MB) is broadcast.
BROADCAST_BUCKETS = 1_000_000
#: So many counted itemsets at most are broadcast.
BROADCAST_SETS = 100_000
#: Levels of itemsets that are grown anew from the baskets, before what has grown is written.
CUT_LEVELS = 6


def basket_count(baskets: DataFrame) -> int:
    return baskets.select("basket").distinct().count()


def profile(baskets: DataFrame) -> DataFrame:
    """One row: baskets, items, items sold, smallest, mean and largest basket, density."""
    sizes = baskets.groupBy("basket").agg(F.count("*").alias("size"))
    a = sizes.agg(F.count("*").alias("baskets"), F.sum("size").alias("sold"), F.min("size").alias("min_size"), F.avg("size").alias("avg_size"), F.max("size").alias("max_size"))
    b = baskets.agg(F.count_distinct("item").alias("items"))
    return a.crossJoin(F.broadcast(b)).withColumn("density", F.col("avg_size") / F.col("items"))  # one row


def item_counts(baskets: DataFrame) -> DataFrame:
    return baskets.groupBy("item").agg(F.count("*").alias("count"))


def top_items(baskets: DataFrame, k: int = 10) -> DataFrame:
    """(item, count, support) of the most frequent items, ties by name."""
    n = basket_count(baskets)
    return item_counts(baskets).withColumn("support", F.col("count") / n).orderBy(F.desc("count"), "item").limit(k)


def extrapolated(baskets: DataFrame, max_k: int = 6) -> DataFrame:
    """(k, itemsets, checks): how many itemsets of each size brute force would count, and checks of one against a basket."""
    n = basket_count(baskets)
    items = baskets.select("item").distinct().count()
    return baskets.sparkSession.createDataFrame([(k, math.comb(items, k), math.comb(items, k) * n) for k in range(1, max_k + 1)], "k int, itemsets long, checks long")


def pair_counts(baskets: DataFrame) -> DataFrame:
    """(a, b, count) of the pairs a < b that occur together."""
    x, y = baskets.select("basket", F.col("item").alias("a")), baskets.select("basket", F.col("item").alias("b"))
    return x.join(y, "basket").where("a < b").groupBy("a", "b").agg(F.count("*").alias("count"))


def brute_force_pairs(baskets: DataFrame) -> DataFrame:
    """(a, b, count) of every pair of items, also those that never occur together. Quadratic in the items by definition."""
    items = materialise(baskets.select("item").distinct(), "items")
    every = items.select(F.col("item").alias("a")).join(items.select(F.col("item").alias("b")), F.col("a") < F.col("b"))
    return every.join(pair_counts(baskets), ["a", "b"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def _frequent(counts: DataFrame, min_count: float) -> DataFrame:
    return counts.where(F.col("count") >= F.lit(float(min_count)))


def join_level(level: DataFrame, k: int) -> DataFrame:
    """Sets of size k from sets of size k-1 (itemset): pairs that differ in the last item, if all their subsets are there."""
    stem = F.slice("itemset", 1, k - 2) if k > 2 else F.array().cast("array<string>")
    x = level.select(stem.alias("stem"), F.element_at("itemset", -1).alias("p"))
    y = x.withColumnRenamed("p", "q")
    made = x.join(y, "stem").where("p < q").select(F.concat("stem", F.array("p", "q")).alias("itemset"))
    if k == 2:
        return made
    drop = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.concat(F.slice("itemset", F.lit(1), i - 1), F.slice("itemset", i + 1, F.lit(k) - i)))
    parts = made.select("itemset", F.explode(drop).alias("part"))
    kept = parts.join(level.select(F.col("itemset").alias("part")), "part", "left_semi").groupBy("itemset").agg(F.count("*").alias("n"))
    return kept.where(F.col("n") == k).select("itemset")


def gathered(baskets: DataFrame) -> DataFrame:
    """(basket, itemset, rest): a row per basket, with an empty itemset and the items in order that may extend it."""
    rows = baskets.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("rest"))
    return rows.select("basket", F.slice("rest", 1, 0).alias("itemset"), "rest")


def _longer(grown: DataFrame, *keys: str) -> DataFrame:
    """(*keys, itemset, rest): each itemset extended by each item of its rest, with what comes after that. Nothing is joined."""
    one = grown.select(*keys, "itemset", "rest", F.posexplode("rest").alias("p", "item"))
    return one.select(*keys, F.concat("itemset", F.array("item")).alias("itemset"), F.slice("rest", F.col("p") + 2, F.size("rest")).alias("rest"))


def _within(rows: DataFrame, sets: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows whose itemset is among ``sets``, of which there are n; broadcast only if these are few."""
    on = [*keys, "itemset"]
    return rows.join(F.broadcast(sets.select(*on)) if n <= BROADCAST_SETS else sets.select(*on).hint("merge"), on, "left_semi")


def _pruned(rows: DataFrame, ones: DataFrame, n: int) -> DataFrame:
    """Gathered baskets without the items that aren't among the n itemsets ``ones`` of one item."""
    items = _within(rows.select("basket", F.explode("rest").alias("item")).withColumn("itemset", F.array("item")), ones, n)
    return materialise(gathered(items.select("basket", "item")), "held")


def apriori(baskets: DataFrame, min_count: float, max_k: int | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(itemset, size, count) of all frequent itemsets, level by level, and (level, candidates, frequent) of each level.

    In each basket, the frequent sets of the last size are extended by a later frequent item, so a level's counting touches
    no set with an infrequent beginning. Baskets are gathered once, and only counts are shuffled.
    """
    return _mined(materialise(gathered(baskets), "gathered"), min_count, max_k)


def _mined(rows: DataFrame, min_count: float, max_k: int | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``apriori`` of gathered baskets."""
    counts = materialise(_longer(rows).groupBy("itemset").agg(F.count("*").alias("count")), "counts")
    level = materialise(_frequent(counts, min_count).select("itemset", F.lit(1).alias("size"), "count"), "level")
    levels = [(1, counts.count(), level.count())]
    found, k = level, 1
    grown = _longer(_pruned(rows, level, levels[0][2]) if levels[0][2] < levels[0][1] else rows)
    while levels[-1][2] and (max_k is None or k < max_k):
        k += 1
        wanted = materialise(join_level(level, k), "candidates")
        n = wanted.count()
        if not n:
            levels.append((k, 0, 0))
            break
        longer = _longer(grown)
        counts = _within(longer, wanted, n).groupBy("itemset").agg(F.count("*").alias("count"))
        level = materialise(_frequent(counts, min_count).select("itemset", F.lit(k).alias("size"), "count"), "level")
        levels.append((k, n, level.count()))
        found = found.unionByName(level)
        grown = _within(longer, level, levels[-1][2])
        if k % CUT_LEVELS == 0:
            grown = materialise(grown, "grown")
    return found, levels


def with_support(found: DataFrame, n: int) -> DataFrame:
    """(itemset, size, count, support) with the itemset as a comma-joined string."""
    return found.select(F.array_join("itemset", ",").alias("itemset"), "size", "count", (F.col("count") / n).alias("support"))


def frequent_items(baskets: DataFrame, min_count: float) -> DataFrame:
    return _frequent(item_counts(baskets), min_count)


def frequent_pairs(baskets: DataFrame, min_count: float) -> DataFrame:
    """(a, b, count)"""
    held = baskets.join(frequent_items(baskets, min_count), "item", "left_semi").select("basket", "item")
    return _frequent(pair_counts(held), min_count)


def frequent_triples(baskets: DataFrame, pairs: DataFrame, min_count: float) -> DataFrame:
    """(a, b, c, count) of triples all of whose pairs are among ``pairs``."""
    inside = lambda df, x, y: df.join(pairs.select(F.col("a").alias(x), F.col("b").alias(y)), [x, y], "left_semi")
    a, b, c = (baskets.select("basket", F.col("item").alias(n)) for n in "abc")
    two = inside(a.join(b, "basket").where("a < b"), "a", "b")
    three = inside(inside(two.join(c, "basket").where("b < c"), "b", "c"), "a", "c")
    return _frequent(three.groupBy("a", "b", "c").agg(F.count("*").alias("count")), min_count)


def pair_rules(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lhs, rhs, conf) in both directions."""
    x = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("lhs"), F.col("b").alias("rhs")), F.struct(F.col("b").alias("lhs"), F.col("a").alias("rhs")))).alias("r"), F.col("count").alias("together")).select("r.*", "together")
    return x.join(items.select(F.col("item").alias("lhs"), "count"), "lhs").select("lhs", "rhs", (F.col("together") / F.col("count")).alias("conf"))


def triple_rules(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """(lhs, rhs, conf): two items, comma-joined, imply the third."""
    one = lambda x, y, z: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(z).alias("rhs"))
    x = triples.select(F.explode(F.array(one("a", "b", "c"), one("a", "c", "b"), one("b", "c", "a"))).alias("r"), F.col("count").alias("together")).select("r.*", "together")
    return x.join(pairs, ["a", "b"]).select(F.concat_ws(",", "a", "b").alias("lhs"), "rhs", (F.col("together") / F.col("count")).alias("conf"))


def top_rules(rules: DataFrame, k: int = 5) -> DataFrame:
    return rules.orderBy(F.desc("conf"), "lhs", "rhs").limit(k)


def item_ids(baskets: DataFrame) -> DataFrame:
    """(item, id): ranks from 0 in the order of names."""
    return numbered(baskets.select("item").distinct(), ["item"], "place").select("item", (F.col("place") - 1).alias("id"))


def keyed(baskets: DataFrame) -> tuple[DataFrame, int]:
    """(basket, item, id); how many items there are."""
    ids = materialise(item_ids(baskets), "ids")
    return materialise(baskets.join(ids, "item").select("basket", "item", "id"), "keyed"), ids.count()


def pair_rows(rows: DataFrame, n: int) -> DataFrame:
    """(a, b, key) for each two items a < b of a basket, with the key that the bucket functions take. Nothing is joined."""
    one = rows.groupBy("basket").agg(F.sort_array(F.collect_list(F.struct("item", "id"))).alias("r")).select("r", F.posexplode("r").alias("p", "x"))
    two = one.select("x", F.explode(F.slice("r", F.col("p") + 2, F.size("r"))).alias("y"))
    return two.select(F.col("x.item").alias("a"), F.col("y.item").alias("b"), (F.col("x.id") * n + F.col("y.id")).alias("key"))


def hashed_pairs(baskets: DataFrame) -> tuple[DataFrame, int]:
    """(a, b, key, count) of all occurring pairs, counted exactly, for comparing table sizes; how many items there are."""
    rows, n = keyed(baskets)
    return materialise(pair_rows(rows, n).groupBy("a", "b", "key").agg(F.count("*").alias("count")), "pairs"), n


def _bitmap(pairs: DataFrame, bucket: Column, min_count: float) -> tuple[DataFrame, int]:
    """(bucket) of the frequent buckets, from rows of pairs that are only counted by bucket; and how many pairs were hashed."""
    counts = materialise(pairs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), "buckets")
    return counts.where(F.col("n") >= F.lit(float(min_count))).select("bucket"), counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def _marked(pairs: DataFrame, bucket: Column, bitmap: DataFrame, n_buckets: int) -> DataFrame:
    held = F.broadcast(bitmap) if n_buckets <= BROADCAST_BUCKETS else bitmap
    return pairs.withColumn("bucket", bucket).join(held, "bucket", "left_semi").drop("bucket")


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("count"))


def _both_frequent(pairs: DataFrame, singles: DataFrame) -> DataFrame:
    return pairs.join(singles.select(F.col("item").alias("a")), "a", "left_semi").join(singles.select(F.col("item").alias("b")), "b", "left_semi")


def _found(singles: DataFrame, candidates: DataFrame, min_count: float) -> DataFrame:
    two = _frequent(candidates, min_count).select(F.array("a", "b").alias("itemset"), F.lit(2).alias("size"), "count")
    return singles.select(F.array("item").alias("itemset"), F.lit(1).alias("size"), "count").unionByName(two)


def pcy(baskets: DataFrame, min_count: float, n_buckets: int = 2000, funnel: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Frequent items and pairs by one hash table of pairs, and the funnel's counts if asked for.

    The first pass counts pairs by bucket only. The second makes pairs of frequent items, and counts those in frequent buckets.
    """
    rows, n = keyed(baskets)
    bucket = F.col("key") % n_buckets
    bitmap, hashed = _bitmap(pair_rows(rows, n), bucket, min_count)
    singles = materialise(frequent_items(baskets, min_count), "singles")
    pairs = pair_rows(rows.join(singles, "item", "left_semi"), n)
    kept = materialise(_counted(_marked(pairs, bucket, bitmap, n_buckets)), "kept")
    stat = {"hashed": hashed, "frequent_buckets": bitmap.count(), "frequent_items": singles.count(), "occurring": _counted(pairs).count(), "candidate_pairs": kept.count()} if funnel else {}
    return _found(singles, kept, min_count), stat


def bucket_sweep(baskets: DataFrame, min_count: float, sizes: tuple[int, ...] = (200, 2000, 20_000, 200_000)) -> DataFrame:
    """(buckets, frequent_share, candidates): what different table sizes let through."""
    pairs, _ = hashed_pairs(baskets)
    singles = frequent_items(baskets, min_count)
    tries = pairs.withColumn("buckets", F.explode(F.array(*(F.lit(s).cast("long") for s in sizes)))).withColumn("bucket", F.col("key") % F.col("buckets"))
    bitmap = tries.groupBy("buckets", "bucket").agg(F.sum("count").alias("n")).where(F.col("n") >= F.lit(float(min_count)))
    share = bitmap.groupBy("buckets").agg((F.count("*") / F.col("buckets")).alias("frequent_share"))
    kept = _both_frequent(tries, singles).join(bitmap, ["buckets", "bucket"], "left_semi").groupBy("buckets").agg(F.count("*").alias("candidates"))
    every = pairs.sparkSession.createDataFrame([(s,) for s in sizes], "buckets long")
    return every.join(share, "buckets", "left").join(kept, "buckets", "left").select("buckets", F.coalesce("frequent_share", F.lit(0.0)).alias("frequent_share"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def multistage(baskets: DataFrame, min_count: float, first: int = 2000, second: int = 1999, factor: int = 7919, funnel: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Frequent items and pairs by two hash tables, the second over what the first lets through, and the funnel's counts if asked
    for. Each pass makes the pairs anew, and only the last counts them one by one."""
    rows, n = keyed(baskets)
    one, two = F.col("key") % first, (F.col("key") * factor) % second
    bitmap1, _ = _bitmap(pair_rows(rows, n), one, min_count)
    singles = materialise(frequent_items(baskets, min_count), "singles")
    after1 = _marked(pair_rows(rows.join(singles, "item", "left_semi"), n), one, bitmap1, first)
    bitmap2, _ = _bitmap(after1, two, min_count)
    kept = materialise(_counted(_marked(after1, two, bitmap2, second)), "kept")
    stat = {"frequent1": bitmap1.count(), "frequent2": bitmap2.count(), "after1": _counted(after1).count(), "candidate_pairs": kept.count()} if funnel else {}
    return _found(singles, kept, min_count), stat


def chunked(baskets: DataFrame, n_chunks: int = 10) -> DataFrame:
    """(chunk, basket, item): baskets by id in contiguous chunks of equal size, the last may be smaller."""
    ids = materialise(numbered(baskets.select("basket").distinct(), ["basket"], "place"), "places")
    size = -(-ids.count() // n_chunks)
    return baskets.join(ids, "basket").select(F.floor((F.col("place") - 1) / max(1, size)).cast("int").alias("chunk"), "basket", "item")


def son(baskets: DataFrame, min_support: float, n_chunks: int = 10, max_k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Frequent itemsets by mining all chunks at once, then counting the union of what is frequent in some chunk; and
    (chunk, rows, local_frequent, max_k). Levels are mined for all chunks together: the chunk is a part of every key.
    """
    placed = materialise(numbered(gathered(baskets), ["basket"], "place"), "places")
    n = placed.count()
    rows = placed.withColumn("chunk", F.floor((F.col("place") - 1) / max(1, -(-n // n_chunks))).cast("int"))
    sizes = materialise(rows.groupBy("chunk").agg(F.count("*").alias("rows")), "sizes")
    local, grown, k = None, rows, 0
    while max_k is None or k < max_k:
        k += 1
        longer = _longer(grown, "chunk")
        counts = longer.groupBy("chunk", "itemset").agg(F.count("*").alias("count")).join(F.broadcast(sizes), "chunk")  # a row per chunk
        level = materialise(counts.where(F.col("count") >= F.lit(min_support) * F.col("rows")).select("chunk", "itemset", F.lit(k).alias("size")), "local")
        m = level.count()
        if not m:
            break
        local = level if local is None else local.unionByName(level)
        grown = _within(longer, level, m, "chunk")
        if k % CUT_LEVELS == 0:
            grown = materialise(grown, "grown")
    if local is None:
        empty = rows.sparkSession.createDataFrame([], "itemset array<string>, size int, count long")
        return empty, sizes.select("chunk", "rows", F.lit(0).cast("long").alias("local_frequent"), F.lit(0).alias("max_k"))
    stats = sizes.join(local.groupBy("chunk").agg(F.count("*").alias("local_frequent"), F.max("size").alias("max_k")), "chunk", "left").select("chunk", "rows", F.coalesce("local_frequent", F.lit(0)).cast("long").alias("local_frequent"), F.coalesce("max_k", F.lit(0)).alias("max_k"))
    return _frequent(_counted_sets(rows, local.select("itemset").distinct()), min_support * n), stats


def count_itemsets(baskets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(itemset, size, count) of the wanted itemsets over all baskets; those that never occur are left out.

    Baskets are extended only along beginnings of wanted sets.
    """
    return _counted_sets(materialise(gathered(baskets), "gathered"), wanted)


def _counted_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``count_itemsets`` of gathered baskets."""
    wanted = materialise(wanted.select("itemset", F.size("itemset").alias("size")), "wanted")
    most = wanted.agg(F.max("size").alias("m")).first().m or 0
    out, grown, n = None, rows, wanted.count()
    for k in range(1, most + 1):
        starts = wanted.where(F.col("size") >= k).select(F.slice("itemset", 1, k).alias("itemset")).distinct()
        grown = _within(_longer(grown), starts, n)
        if k % CUT_LEVELS == 0:
            grown = materialise(grown, "grown")
        counts = _within(grown, wanted.where(F.col("size") == k), n).groupBy("itemset").agg(F.count("*").alias("count")).select("itemset", F.lit(k).alias("size"), "count")
        out = counts if out is None else out.unionByName(counts)
    return out if out is not None else rows.sparkSession.createDataFrame([], "itemset array<string>, size int, count long")


def negative_border(found: DataFrame, universe: DataFrame) -> DataFrame:
    """(itemset, size): sets that aren't frequent while all their subsets are, of the items (item) of ``universe``."""
    ones = found.where("size = 1").select(F.col("itemset")[0].alias("item"))
    border = universe.select("item").distinct().join(ones, "item", "left_anti").select(F.array("item").alias("itemset"), F.lit(1).alias("size"))
    most = found.agg(F.max("size").alias("m")).first().m or 0
    for k in range(2, most + 2):
        made = join_level(found.where(F.col("size") == k - 1).select("itemset"), k)
        border = border.unionByName(made.join(found.where(F.col("size") == k).select("itemset"), "itemset", "left_anti").select("itemset", F.lit(k).alias("size")))
    return border


def sampled(baskets: DataFrame, fraction: float, seed: str) -> DataFrame:
    """Whole baskets, each by a uniform number from the md5 of seed and id."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("basket").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    return baskets.where(u < fraction)


def toivonen(baskets: DataFrame, min_support: float, fraction: float = 0.2, lower: float = 0.8, decay: float = 0.8, max_attempts: int = 6, max_k: int | None = None) -> tuple[DataFrame | None, list[tuple]]:
    """Frequent itemsets from a sample, proved complete by its negative border; None if no attempt succeeds.

    Also (attempt, factor, sample, sample_frequent, border, border_hits) of each attempt.
    """
    rows = materialise(gathered(baskets), "gathered")
    n, universe, attempts = rows.count(), materialise(rows.select(F.explode("rest").alias("item")).distinct(), "universe"), []
    for i in range(max_attempts):
        sample = materialise(sampled(rows, fraction, f"toivonen-{i}"), "sample")
        size = sample.count()
        local, _ = _mined(sample, lower * min_support * size, max_k)
        border = materialise(negative_border(local, universe), "border")
        wanted = local.select("itemset", F.lit(False).alias("edge")).unionByName(border.select("itemset", F.lit(True).alias("edge")))
        counts = materialise(_counted_sets(rows, wanted.select("itemset")).join(wanted, "itemset"), "counts")
        bad = counts.where("edge").where(F.col("count") >= F.lit(float(min_support * n))).count()
        attempts.append((i + 1, lower, size, local.count(), border.count(), bad))
        if not bad:
            return _frequent(counts.where("not edge"), min_support * n).select("itemset", "size", "count"), attempts
        lower *= decay
    return None, attempts
