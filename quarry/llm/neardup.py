"""Near-duplicate documents by an LSH forest of MinHash signatures.

1. One pass over the texts gives each document's distinct shingles as a set digest, a MinHash signature and a 2-bit
   sketch of it. Documents with equal sets form a class, of which only the smallest id goes on.
2. The signature is cut into several trees of ``DEPTH`` hashes. In each tree the classes are sorted by the signature,
   that tree's hashes first, within regions of a common prefix; candidates are the next neighbours in that order, so those with the longest common prefixes,
   and the region's first class. A region's depth adapts: one with more than ``REGION`` members is split by a longer
   prefix, twice, and what is still larger, by salt. A class so yields a bounded number of candidates per tree.
   Classes of a region of more members than are all paired so are crowded.
3. Candidates whose sizes or sketches rule out the similarity go. The others are confirmed on the full sets from the
   texts: first one candidate per class, then those that still lie in different components.
4. Crowded classes are joined exactly by prefix filter: with the shingles of a set in one order for all, the rarest first,
   a pair of the similarity has a first common shingle early in both sets and very early in one of them. Pairs that have
   one, lie in different components and haven't been compared are confirmed as above. No pair of them is left out for
   a region's size.
5. Components by alternating stars, all in tables.

Defined results: null texts and texts without words have an empty set and are linked with nothing; rows with null doc_id
are linked with nothing and kept; rows repeated with one doc_id are one document, whose text is that of the smallest hash
if they differ (those without words stay empty rows of their own); columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, keeps_columns, materialise, released, settled, table, texts
from quarry.llm.components import components
from quarry.llm.shingles import mix, sets_of

TREES, DEPTH = 16, 8
PREFIXES = (3, 5, 8)
#: Of each MinHash value the low 16 bits are kept, which differ if the values do but for one case in 65,536.
BYTES = 2
REGION = 500
#: The ids of candidates, and of documents that go, are broadcast, to pick texts without a shuffle, up to so many (24 MB); else joined.
BROADCAST_IDS = 1_000_000
NEIGHBOURS = 4
PERCENT = 85
_RANDOM = np.random.default_rng(20240229)
_A = (_RANDOM.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_SIGNED = "doc_id long, x long, n long, d1 long, d2 long, sig binary, s0 long, s1 long, s2 long, s3 long"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (sets, hashes) of sets that aren't empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((TREES * DEPTH, len(sets)), np.uint32)
    for i in range(TREES * DEPTH):
        out[i] = np.minimum.reduceat(x * _A[i] + _B[i], at)
    return np.ascontiguousarray(out.T)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        all_texts = list(texts(batch.column("text")))
        ids = batch.column("doc_id")
        for first, sets in sets_of(all_texts):
            full = [i for i, s in enumerate(sets) if len(s)]
            if not full:
                continue
            own = [sets[i] for i in full]
            at = np.concatenate([[0], np.cumsum([len(s) for s in own])[:-1]])
            flat = np.concatenate(own)
            d1, d2 = np.add.reduceat(mix(flat + np.uint64(1)), at), np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
            sig = signatures(own)
            low = mix(sig.astype(np.uint64) + np.uint64(1))
            bits = np.stack([(low >> np.uint64(7)) & np.uint64(1), (low >> np.uint64(19)) & np.uint64(1)], axis=2).astype(np.uint8).reshape(len(own), -1)
            sketch = np.packbits(bits, axis=1).view(np.int64)
            raw = sig.astype(np.uint16).tobytes()
            width = TREES * DEPTH * BYTES
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array([first + i for i in full])) for c in (ids, batch.column("x"))), pa.array([len(s) for s in own], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array([raw[i * width : (i + 1) * width] for i in range(len(own))], pa.binary()), *(pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(4))],
                [c.split()[0] for c in _SIGNED.split(", ")],
            )


def _agree() -> Column:
    """In how many of the 128 values the sketches (x0..x3) and (y0..y3) agree."""
    differ = F.lit(0)
    for j in range(4):
        x = F.col(f"x{j}").bitwiseXOR(F.col(f"y{j}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return F.lit(TREES * DEPTH) - differ


def least_agreement(percent: int) -> int:
    """Two sketches of 128 2-bit values agree in (1+3J)/4 of them on average; this is 6 standard deviations less."""
    share = (1 + 3 * percent / 100) / 4
    return int(TREES * DEPTH * share - 6 * (TREES * DEPTH * share * (1 - share)) ** 0.5)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of classes (rep, n, sig, sketch) that stand close in some tree; and (rep): the crowded classes, which share a
    region with some that they may not be paired with."""
    prefix = lambda tree, depth: F.xxhash64("t", F.substr(tree, F.lit(1), F.lit(depth * BYTES)))
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substr(F.col("sig"), t * (DEPTH * BYTES) + 1, F.lit(DEPTH * BYTES)))
    rows = classes.select("rep", F.posexplode(trees).alias("t", "p"))
    found, crowded = [], None
    for depth in PREFIXES:
        last = depth == PREFIXES[-1]
        keyed = rows.withColumn("k", prefix(F.col("p"), depth))
        size = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("lead")).where("c > 1")
        level = materialise(keyed.join(size, "k"), "level")
        if crowded is None:
            crowded = level.where(F.col("c") > NEIGHBOURS + 1).select("rep").distinct()
        here = level if last else level.where(F.col("c") <= REGION)
        turn = F.col("t") * (DEPTH * BYTES)  # sorted by the whole signature, this tree's hashes first
        here = here.join(classes.select("rep", "sig"), "rep").withColumn("p", F.concat(F.substr("sig", turn + 1, F.length("sig")), F.substr(F.col("sig"), F.lit(1), turn)))
        w = Window.partitionBy("k", "salt").orderBy("p", "rep")
        near = here.withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / REGION)) if last else F.lit(0)).select("rep", "lead", F.array(*(F.lead("rep", i).over(w) for i in range(1, NEIGHBOURS + 1))).alias("next"))
        found.append(near.select("rep", F.explode(F.array_distinct(F.filter(F.concat("next", F.array("lead")), lambda x: x.isNotNull()))).alias("other")))
        full = level.where(F.col("c") > REGION)
        if last or full.isEmpty():
            break
        found.append(full.select("rep", F.col("lead").alias("other")))
        rows = full.select("rep", "t", "p")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.where("rep <> other").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct(), crowded


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, h): a row per distinct shingle, n in all."""
    for batch in released(batches):
        every = list(texts(batch.column("text")))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for first, sets in sets_of(every):
            n = np.array([len(x) for x in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[first : first + len(sets)], n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "n", "h"])


def prefix_pairs(docs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of documents (id, text), in different components of ``parts`` (node, component), that can reach the similarity:
    all of them that do are among these.

    Shingles are in the order of their frequency, ties by hash. Two sets of x and y members whose first common one is at the
    places i and j have at most min(x - i, y - j) in common, of which the similarity takes a share of x + y; so i + j is
    bounded too, and one of i and j by half.
    """
    part = 100 + percent
    own = materialise(docs.mapInArrow(_shingles, "id long, n long, h long"), "shingles")
    shared = own.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    sets = own.join(shared, "h").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"))
    #: What no other has comes first, in no row.
    places = sets.select("id", "n", F.posexplode("s").alias("p", "s"), (F.col("n") - F.size("s")).alias("before")).select("id", "n", (F.col("p") + F.col("before")).alias("i"), F.col("s.h").alias("h")).where(100 * F.col("i") <= (100 - percent) * F.col("n"))
    places = places.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    places = materialise(places, "places")
    mixed = places.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("h")
    places = places.join(mixed, "h", "left_semi")
    early = places.where(part * F.col("i") <= (100 - percent) * F.col("n"))
    x, y = (f.select("h", *(F.col(c).alias(c + s) for c in ("id", "n", "i", "component"))) for f, s in ((early, "x"), (places, "y")))
    met = x.join(y, "h").where("componentx <> componenty").where(part * F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= percent * (F.col("nx") + F.col("ny")))
    return met.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets reach the similarity."""
    for batch in released(batches):
        a, b = list(texts(batch.column("ta"))), list(texts(batch.column("tb")))
        one = {t: None for t in (*a, *b)}
        keys = list(one)
        sets: dict[bytes, np.ndarray] = {}
        for first, some in sets_of(keys):
            sets.update(zip(keys[first : first + len(some)], some, strict=True))
        good = []
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = sets[x], sets[y]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                good.append(i)
        take = pa.array(good, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["a", "b"])


def confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """``held``: (id, held_text)."""
    x = pairs.join(held.select(F.col("id").alias("b"), F.col("held_text").alias("tb")), "b")
    x = x.join(held.select(F.col("id").alias("a"), F.col("held_text").alias("ta")), "a")
    return x.select("a", "b", "ta", "tb").mapInArrow(lambda batches: _confirm(batches, percent), "a long, b long")


def _picked(rows: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """(id, text) of each of ``ids`` (id)."""
    few = ids.count() <= BROADCAST_IDS
    picked = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")
    return picked.groupBy(F.col("doc_id").alias("id")).agg(F.min_by("text", "x").alias(text))


def merge(pairs: DataFrame, rows: DataFrame, parts: DataFrame | None, percent: int) -> DataFrame:
    """``parts`` (node, component), joined by the links among ``pairs``: one pair per document is confirmed first, then those
    between components."""
    if parts is not None and pairs.isEmpty():
        return parts
    involved = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "involved")
    held = materialise(_picked(rows, involved, "held_text"), "held")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    for some in (first, pairs.join(first, ["a", "b"], "left_anti")):
        if parts is not None:
            some = some.join(parts.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(parts.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            some = materialise(some.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "rest")
        links = materialise(confirmed(some, held, percent), "links")
        if parts is None:
            parts = components(links)
        elif not links.isEmpty():
            parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
    return parts


def label(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``. Links: 100 * intersection >= ``percent`` * union."""
    return settled(lambda: _label(docs, percent), "labels")


def _label(docs: DataFrame, percent: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("x", F.when(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64("text")))
    empty = rows.where("doc_id is null or x is null").select("doc_id")
    rows = rows.where("doc_id is not null and x is not null")
    signed = materialise(rows.mapInArrow(_sign, _SIGNED), "signed")
    doubled = signed.groupBy("doc_id").agg(F.min("x").alias("x"), F.max("x").alias("other")).where("x <> other").select("doc_id", "x")
    if not doubled.isEmpty():
        one = signed.join(doubled, ["doc_id", "x"]).dropDuplicates(["doc_id"])  # rows of one hash have equal signatures
        signed = materialise(signed.join(doubled, "doc_id", "left_anti").unionByName(signed.select("doc_id").join(one, "doc_id")), "signed")
    classes = materialise(signed.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    heads = signed.join(classes.select("n", "d1", "d2", F.col("rep").alias("doc_id")), ["n", "d1", "d2", "doc_id"]).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep")
    heads = materialise(heads.select("rep", "n", "sig", "s0", "s1", "s2", "s3"), "heads")
    side = lambda id_, n, s: heads.select(F.col("rep").alias(id_), F.col("n").alias(n), *(F.col(f"s{j}").alias(f"{s}{j}") for j in range(4)))
    near, crowded = candidates(heads)
    near, crowded = materialise(near, "near"), materialise(crowded.withColumnRenamed("rep", "id"), "crowded")
    alike = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (_agree() >= least_agreement(percent))
    screened = lambda p: p.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b").where(alike).select("a", "b")
    parts = merge(materialise(screened(near), "pairs"), rows, None, percent)
    full = _picked(rows, crowded, "text")
    parts = merge(materialise(screened(prefix_pairs(full, parts, percent).join(near, ["a", "b"], "left_anti")), "pairs"), rows, parts, percent)
    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    linked = signed.select("doc_id", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = empty.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@keeps_columns("doc_id", "text")
def distinct_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, in the columns of ``docs``."""
    gone = label(docs, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return label(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM sym UNION SELECT r.doc_id, s.b FROM reach r JOIN sym s ON s.a = r.other)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) m USING (doc_id)
"""
