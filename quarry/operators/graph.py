"""Friend recommendation and link analysis over edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.similarity import paired
from quarry.storage import materialise

#: Steps of an iteration between tables written to cut lineage.
CUT_EVERY = 8
#: Friends of a user that are paired in one go.
HUB = 2000


def undirected(edges: DataFrame) -> DataFrame:
    """(user, friend) in both directions, each once, without loops."""
    both = edges.select(F.col("src").alias("user"), F.col("dst").alias("friend")).unionByName(edges.select(F.col("dst").alias("user"), F.col("src").alias("friend")))
    return both.where("user <> friend").distinct()


def mutual_friends(friends: DataFrame) -> DataFrame:
    """(a, b, mutual) for pairs a < b with common friends who are no friends themselves. A hub's pairs are made in blocks."""
    pairs = paired(friends.select(F.col("friend").alias("middle"), F.col("user").alias("doc_id")), ["middle"], HUB).groupBy(F.col("i").alias("a"), F.col("j").alias("b")).agg(F.count(F.lit(1)).alias("mutual"))
    return pairs.join(friends.select(F.col("user").alias("a"), F.col("friend").alias("b")), ["a", "b"], "left_anti")


def _second_degree(friends: DataFrame) -> DataFrame:
    """(user, candidate, mutual): friends of friends who are no friends, in both directions, dealt by user. What is shuffled is
    each friend's list of friends, a hub's in blocks, to each user that it is for; pairs are made and counted where the user is."""
    held = friends.select(F.col("friend").alias("middle"), "user", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("friend")) / HUB).alias("blocks"))
    lists = held.groupBy("middle", F.pmod(F.xxhash64("user"), F.col("blocks")).alias("block")).agg(F.collect_list("user").alias("candidates"))
    asked = held.select("middle", "user", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    paths = asked.hint("merge").join(lists, ["middle", "block"]).select("user", "candidates", F.lit(1).alias("path"))
    known = friends.select("user", F.array("friend").alias("candidates"), F.lit(0).alias("path"))
    pairs = paths.unionByName(known).repartition("user").select("user", F.explode("candidates").alias("candidate"), "path").where("candidate <> user")
    return pairs.groupBy("user", "candidate").agg(F.sum("path").alias("mutual"), F.min("path").alias("new")).where("new = 1").select("user", "candidate", "mutual")


def recommendations(friends: DataFrame, k: int = 10, users: list[int] | None = None) -> DataFrame:
    """(user, candidate, mutual, rank): the k candidates with most mutual friends, ties to the smaller id.

    Given some users, only the paths that start at them are followed.
    """
    if users is None:
        both = _second_degree(friends)
    else:
        first = friends.where(F.col("user").isin(users)).select("user", F.col("friend").alias("middle"))
        both = first.join(friends.select(F.col("user").alias("middle"), F.col("friend").alias("candidate")), "middle").where("candidate <> user").groupBy("user", "candidate").agg(F.count(F.lit(1)).alias("mutual"))
        both = both.join(friends.withColumnRenamed("friend", "candidate"), ["user", "candidate"], "left_anti")
    best = Window.partitionBy("user").orderBy(F.desc("mutual"), "candidate")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("user", "candidate", "mutual", "rank")


def recommendation_lists(users: DataFrame, recs: DataFrame) -> DataFrame:
    """(user, candidates): a comma-joined list for every user, empty for those without any."""
    lists = recs.groupBy("user").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"].cast("string")), ",").alias("candidates"))
    return users.join(lists, "user", "left").select("user", F.coalesce("candidates", F.lit("")).alias("candidates"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """(nodes, edges): nodes is the largest id, as ids are dense from 1."""
    return edges.agg(F.coalesce(F.greatest(F.max("src"), F.max("dst")), F.lit(0)).cast("long").alias("nodes"), F.count(F.lit(1)).alias("edges"))


def _nodes(edges: DataFrame) -> tuple[DataFrame, int]:
    n = graph_stats(edges).first().nodes
    return edges.sparkSession.range(1, n + 1).select(F.col("id").alias("node")), n


def _held(links: DataFrame, near: str) -> DataFrame:
    """Links (src, dst, w) kept in the executors by their end ``near``, in as many partitions as an aggregate has."""
    return links.repartition(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), near).cache()


def _passed(scores: DataFrame, held: DataFrame, near: str, far: str) -> DataFrame:
    """(node, x): sums at ``far`` of x times w. Scores lie by node as the links do by ``near``, so only what arrives at ``far``
    is shuffled. The scores are the hashed side, never a broadcast: the size of a compressed table says little about its rows."""
    return scores.hint("shuffle_hash").join(held, F.col("node") == F.col(near)).groupBy(F.col(far).alias("node")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))


def _links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w): the edges, and each node with itself at weight 0, so that every node is in every sum."""
    return edges.select("src", "dst", F.lit(1.0).alias("w")).unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("w")))


def pagerank(edges: DataFrame, beta: float = 0.8, iterations: int = 40, redistribute: bool = False) -> DataFrame:
    """(node, score). Without ``redistribute``, the rank of nodes without successors leaks."""
    edges = materialise(edges, "edges")
    nodes, n = _nodes(edges)
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    degree = F.sum("w").over(Window.partitionBy("src"))
    links = materialise(_links(edges, nodes).withColumn("w", F.coalesce(F.try_divide(F.col("w"), degree), F.lit(0.0))), "links")
    out = _held(links, "src")
    rank = nodes.withColumn("x", F.lit(1.0 / n))
    for step in range(iterations):
        rank = _passed(rank, out, "src", "dst").select("node", (F.lit((1 - beta) / n) + beta * F.col("x")).alias("x"))
        if redistribute:
            lost = rank.agg(((1 - F.sum("x")) / n).alias("lost"))
            rank = rank.crossJoin(F.broadcast(lost)).select("node", (F.col("x") + F.col("lost")).alias("x"))  # one row
        if step % CUT_EVERY == CUT_EVERY - 1 or step == iterations - 1:
            rank = materialise(rank, "rank")
    out.unpersist()
    return rank.select("node", F.col("x").alias("score"))


def hits(edges: DataFrame, iterations: int = 40) -> DataFrame:
    """(node, hub, authority), each scaled so that its largest value is 1; all 0 if nothing links.

    Scaling commutes with the steps, so it is done where lineage is cut and at the end, not in every step.
    """
    edges = materialise(edges, "edges")
    nodes, n = _nodes(edges)
    links = materialise(_links(edges, nodes), "links")
    out, into = _held(links, "src"), _held(links, "dst")

    def scaled(score: DataFrame, kind: str) -> DataFrame:
        score = materialise(score, kind)
        most = score.agg(F.max("x").alias("most")).first().most
        return score.select("node", (F.col("x") / most).alias("x")) if most else score

    hub, authority = nodes.withColumn("x", F.lit(1.0)), nodes.withColumn("x", F.lit(0.0))
    for i in range(iterations):
        cut = i % CUT_EVERY == CUT_EVERY - 1 or i == iterations - 1
        authority = _passed(hub, out, "src", "dst")
        authority = scaled(authority, "authority") if cut else authority
        hub = _passed(authority, into, "dst", "src")
        hub = scaled(hub, "hub") if cut else hub
    out.unpersist()
    into.unpersist()
    return hub.withColumnRenamed("x", "hub").join(authority.withColumnRenamed("x", "authority"), "node")


def top(scores: DataFrame, column: str = "score", k: int = 5) -> DataFrame:
    """The k largest, ties to the smaller node."""
    return scores.orderBy(F.desc(column), F.asc("node")).limit(k)


def bottom(scores: DataFrame, column: str = "score", k: int = 5) -> DataFrame:
    """The k smallest, ties to the larger node."""
    return scores.orderBy(F.asc(column), F.desc("node")).limit(k)
