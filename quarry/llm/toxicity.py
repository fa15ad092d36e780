"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Learning takes a stratified sample of the labelled documents, at most ``MAX_EXAMPLES`` of each label (all of them where
there are fewer; the smallest md5 of the id goes first). Terms are words and their beginnings of some lengths, so that forms of one stem
meet; all of those in the sample make the vocabulary, and one aggregate over all documents counts in how many each occurs.
Examples and queries are TF-IDF vectors over it; what no example has would only scale a query. The index grows with the
examples' texts and not with the documents; it and the vocabulary are broadcast, and nothing else is.

The inverted index holds the examples in blocks of ``BLOCK``, like next to like. Postings of rare terms are lists of examples,
and those of the ``HEAD`` terms that most examples have are a row of weights for each block, with the block's largest weight.
A query adds up its rare terms; with the largest weights of the others, this bounds what any example of a block can reach.
The blocks of the largest bounds are scored first, and those whose bound is below the k-th best so far can't hold one of the k
nearest, so these are exact. Queries go together so that a block is one product with all of them that need it; rare terms are
added up a query at a time.

Votes of circles of the nearest are weighted by closeness and the sampling of the labels is
undone by weights. A text of over ``PART_WORDS`` words is looked up as a whole and in parts of about so many, as one vile passage says
little in the whole, and each circle's largest vote of a part counts beside that of the whole. A logistic curve fitted to
leave-one-out votes of the examples, parts included, makes them probabilities. Terms are known by 64-bit hashes.

Defined results: null and empty texts, and texts without a term of the vocabulary, get the score of no evidence; labels
that are null, other than 0 and 1, or contradict each other for a document are not used; of texts with one doc_id the smallest
is learned from; without examples of both labels
every score is the share of label 1 among the labels known, 0 without any; rows repeated get equal scores; columns other
than doc_id and text (doc_id and toxic in labels) are not read, and doc_id only chooses what is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, fold, give_back, keeps_columns, materialise, pieces, released, table, texts
from quarry.llm.decontaminate import SEPARATED
from quarry.llm.shingles import PIECE_BYTES, mix, powers
from quarry.operators.order import spread

MAX_EXAMPLES = 1536
MAX_TERM_BYTES = 64
#: Lengths in bytes of the beginnings of words.
STEMS = (4, 6)
#: Terms with a row in each block; examples of a block; groups of like examples that are put side by side.
HEAD, BLOCK, PIVOTS = 1024, 64, 32
#: Queries that are looked up together.
GROUP = 128
#: Added to bounds, for the error of single precision.
SLACK = 1e-4
#: Neighbours that vote together, nearest first: at least so many, or one of so many examples.
CIRCLES = ((5, 80), (10, 27), (25, 10))
CUTOFF = 0.7
#: Weight of the prior in a vote, in neighbours of cosine 1.
PRIOR_WEIGHT = 0.01
PART_WORDS = 550


def term_hashes(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, terms) hashes of each word and its beginnings, 0 where it has none, and where each text's words begin (an entry more
    at the end)."""
    data = np.frombuffer(b" ".join([*group, b""]).translate(SEPARATED), np.uint8)
    edge = np.diff((data == 0x20).view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    n, base = end - start, sums[start]
    out = np.zeros((len(start), 1 + len(STEMS)), np.uint64)
    for j, size in enumerate((MAX_TERM_BYTES, *STEMS)):
        own = n > size if j else n <= size
        at = start[own]
        stop = at + size if j else end[own]
        out[own, j] = mix((sums[stop] - base[own]) * down[at] + (stop - at).astype(np.uint64) + np.uint64(j << 32)) | np.uint64(1)
    return out, np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in group])]))


class Vocabulary:
    """Places of hashes in a sorted list of distinct ones, by a table four times as large and open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.rounds, left = np.full(1 << bits, -1, np.int32), 0, np.arange(len(keys), dtype=np.int32)
        while len(left):
            at = self._slot(keys[left], self.rounds)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several, one
            left, self.rounds = left[self.slots[at] != left], self.rounds + 1

    def __len__(self) -> int:
        return len(self.keys)

    def _slot(self, keys: np.ndarray, r: int) -> np.ndarray:
        return ((keys >> self.shift).astype(np.int64) + r) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places, -1 where there is none."""
        out, live = np.full(len(hashes), -1, np.int32), np.flatnonzero(hashes)
        for r in range(self.rounds):
            at = self.slots[self._slot(hashes[live], r)]
            live, at = live[at >= 0], at[at >= 0]
            hit = self.keys[at] == hashes[live]
            out[live[hit]] = at[hit]
            live = live[~hit]
        return out

    def count(self, group: list[bytes], size: int | None = None) -> tuple[np.ndarray, ...]:
        """Of the texts' parts of about ``size`` words: the text of each (one part at least), and in order (part, term, count)."""
        found, first = term_hashes(group)
        n = np.diff(first)
        parts = np.maximum(1, -(-n // size)) if size else np.ones(len(n), np.int64)
        text = np.repeat(np.arange(len(n)), n)
        part = (np.cumsum(parts) - parts)[text] + (np.arange(first[0], first[-1]) - first[text]) * parts[text] // np.maximum(n, 1)[text]
        term = self.find(found.ravel())
        held = term >= 0
        key, count = np.unique(np.repeat(part, found.shape[1])[held] * len(self) + term[held], return_counts=True)
        return np.repeat(np.arange(len(n)), parts), key // max(1, len(self)), key % max(1, len(self)), count


def joined(part: np.ndarray, term: np.ndarray, count: np.ndarray, to: np.ndarray, terms: int) -> tuple[np.ndarray, ...]:
    """(text, term, count) from counts by part, each part's text given by ``to``."""
    key, at = np.unique(to[part] * terms + term, return_inverse=True)
    return key // max(1, terms), key % max(1, terms), np.bincount(at, count, len(key))


@dataclass
class Model:
    terms: Vocabulary
    idf: np.ndarray
    row: np.ndarray  # of a term in head, or -1
    head: np.ndarray  # (blocks, rows, BLOCK) weights
    most: np.ndarray  # (rows, blocks) the largest of them
    start: np.ndarray  # where each other term's part of place and value begins, an entry more at the end
    place: np.ndarray  # examples that have the term
    value: np.ndarray  # and its weight in them
    labels: np.ndarray  # of the examples, in the index' order
    ids: np.ndarray
    weight: np.ndarray  # of an example by its label, for the sampling
    prior: float
    curve: np.ndarray  # factors of the votes, and what is added
    shared: Broadcast | None = None  # the index, without the curve

    @property
    def circles(self) -> list[int]:
        return [max(least, len(self.ids) // part) for least, part in CIRCLES]

    def weights(self, query: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Of each (query, term, count) the weight in the query's unit vector; n queries."""
        v = (1 + np.log(count)) * self.idf[term]
        return (v / np.sqrt(np.bincount(query, v * v, n))[query]).astype(np.float32)

    def nearest(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int | None = None, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of n queries, places and cosines of the k examples (the largest circle) of largest positive cosine, ties to the
        smaller id. Queries are given as rows (query, term, weight) in order; of each, one place may be left out."""
        k = k or self.circles[-1]
        edge = np.searchsorted(query, np.arange(0, n + GROUP, GROUP))
        for g, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            size = min(GROUP, n - g * GROUP)
            yield from self._group(query[a:b] - g * GROUP, term[a:b], weight[a:b], size, k, None if without is None else without[g * GROUP : g * GROUP + size])

    def _rare(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """(n, places) sums over terms outside the head, a query at a time: what one needs in between fits a core's cache."""
        out = np.empty((n, len(self.head) * BLOCK))
        many = self.start[term + 1] - self.start[term]
        end = np.append(0, np.cumsum(many))
        shift, wide = self.start[term] - end[:-1], weight.astype(np.float64)
        edge = np.searchsorted(query, np.arange(n + 1))
        for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            at = np.repeat(shift[a:b], many[a:b])
            at += np.arange(end[a], end[b])
            out[i] = np.bincount(self.place[at], self.value[at] * np.repeat(wide[a:b], many[a:b]), out.shape[1])
        return out

    def _group(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, without: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        blocks = len(self.head)
        row = self.row[term]
        own = row >= 0
        q = np.zeros((n, self.head.shape[1]), np.float32)
        q[query[own], row[own]] = weight[own]
        cos = self._rare(query[~own], term[~own], weight[~own], n).reshape(n, blocks, BLOCK)
        bound = cos.max(2) + q @ self.most + SLACK
        done = np.zeros((n, blocks), bool)
        exact = np.zeros((n, blocks, BLOCK))

        def add(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)):
                some = np.flatnonzero(wanted[:, b])
                exact[some, b] = cos[some, b] + q[some] @ self.head[b]
            done[wanted] = True

        first = np.argsort(-bound, axis=1, kind="stable")[:, : -(-2 * k // BLOCK)]
        wanted = np.zeros((n, blocks), bool)
        np.put_along_axis(wanted, first, True, 1)
        add(wanted)
        if not done.all():
            least = -np.partition(-exact.reshape(n, -1), k - 1, axis=1)[:, k - 1]
            add((bound >= least[:, None]) & ~done)
        exact = np.round(exact.reshape(n, -1), 6)
        if without is not None:
            exact[np.arange(n), without] = 0
        kth = -np.partition(-exact, k - 1, axis=1)[:, k - 1] if k < exact.shape[1] else np.zeros(n)
        for i in range(n):
            places = np.flatnonzero(exact[i] >= max(kth[i], 1e-6))
            found = exact[i, places]
            best = np.lexsort((self.ids[places], -found))[:k]
            yield places[best], found[best]

    def votes(self, ids: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 from distance-weighted votes of each circle of neighbours and the prior."""
        w = np.zeros((2, len(ids) + 1))
        w[0, 1:] = cos.astype(np.float64) ** 2 * self.weight[ids]
        w[1, 1:] = w[0, 1:] * self.labels[ids]
        every, ones = np.cumsum(w, axis=1)[:, np.minimum(self.circles, len(ids))]
        one = ones + PRIOR_WEIGHT * self.prior
        return np.log(one / (every + PRIOR_WEIGHT - one))

    def evidence(self, text: np.ndarray, part: np.ndarray, term: np.ndarray, count: np.ndarray, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text, from what ``Vocabulary.count`` returns: votes of the whole and the largest of its parts; places and cosines
        of the whole's neighbours. Of each text, one place may be left out."""
        n = int(text[-1]) + 1 if len(text) else 0
        whole = joined(part, term, count, text, len(self.terms))
        several = np.bincount(text, minlength=n) > 1
        mine = several[text][part] if len(part) else np.zeros(0, bool)
        found = self.nearest(whole[0], whole[1], self.weights(*whole, n), n, without=without)
        inner = np.flatnonzero(several[text])  # parts that are looked up
        number = np.cumsum(several[text]) - 1
        query = number[part[mine]]
        sought = self.nearest(query, term[mine], self.weights(query, term[mine], count[mine], len(inner)), len(inner), without=None if without is None else without[text[inner]])
        sizes = np.bincount(text, minlength=n)
        for i, (ids, cos) in enumerate(found):
            votes = self.votes(ids, cos)
            largest = np.max([self.votes(*next(sought)) for _ in range(sizes[i])], axis=0) if several[i] else votes
            yield np.concatenate([votes, largest]), ids, cos

    def share(self, spark: SparkSession) -> Broadcast:
        if self.shared is None:
            self.shared = spark.sparkContext.broadcast(self)
        return self.shared


def probability(votes: np.ndarray, curve: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(votes @ curve[:-1] + curve[-1], -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic fit with a slight pull towards the votes' mean, by Newton steps."""
    rest = np.append(np.full(x.shape[1], 1 / x.shape[1]), 0)
    beta, X = rest.copy(), np.hstack([x, np.ones((len(x), 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        grad = X.T @ (w * (p - y)) + 0.5 * (beta - rest)
        hess = (X * (w * p * (1 - p))[:, None]).T @ X + 0.5 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def build(terms: Vocabulary, df: np.ndarray, n_docs: int, ids: np.ndarray, labels: np.ndarray, counts: tuple[np.ndarray, ...], shares: dict[int, float]) -> Model:
    """Index of examples, from counts (example, term, count) in order. shares: of each label among all labels known."""
    model = Model(terms, np.log((n_docs + 1) / (df + 1.0)) + 1, *(np.zeros(0),) * 9, shares[1], np.zeros(0))
    size, (place, word, n) = len(ids), counts
    value = model.weights(place, word, n, size)
    top = np.argsort(-np.bincount(word, minlength=len(terms)), kind="stable")[:HEAD]
    model.row = np.full(len(terms), -1, np.int32)
    model.row[top] = np.arange(len(top))
    dense, blocks = model.row[word] >= 0, -(-size // BLOCK)
    head = np.zeros((len(top), blocks * BLOCK), np.float32)
    head[model.row[word[dense]], place[dense]] = value[dense]
    order = _like_by_like(head[:, :size])
    head[:, :size] = head[:, order]
    model.head = np.ascontiguousarray(head.reshape(len(top), blocks, BLOCK).transpose(1, 0, 2))
    model.most = head.reshape(len(top), blocks, BLOCK).max(2)
    at = np.empty(size, np.int32)
    at[order] = np.arange(size)
    by = np.argsort(word[~dense], kind="stable")
    model.place, model.value = at[place[~dense]][by], value[~dense][by]
    model.start = np.concatenate([[0], np.cumsum(np.bincount(word[~dense], minlength=len(terms)))])
    model.labels, model.ids = labels[order], ids[order]
    seen = np.bincount(labels, minlength=2)
    model.weight = np.array([shares[y] * size / seen[y] if y in shares else 0.0 for y in (0, 1)])[model.labels]
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Fits the curve to the votes on the examples (id, text), each without itself."""
    held = model.share(rows.sparkSession)
    give_back()

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        place = {int(i): at for at, i in enumerate(m.ids)}
        for batch in released(batches):
            every, at = list(texts(batch.column("text"))), np.array([place[i] for i in batch.column("id").to_pylist()])
            for a, b in pieces([len(t) for t in every], PIECE_BYTES):
                found = [v for v, _, _ in m.evidence(*m.terms.count(every[a:b], PART_WORDS), without=at[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(at[a:b]), pa.array(found, pa.list_(pa.float64()))], ["place", "votes"])

    found = spread(rows).mapInArrow(votes, "place long, votes array<double>").toArrow().sort_by("place")  # at most 2 * MAX_EXAMPLES rows
    at = found.column("place").to_numpy()
    model.curve = _logistic(np.array(found.column("votes").to_pylist()), model.labels[at].astype(float), model.weight[at])


def _like_by_like(head: np.ndarray) -> np.ndarray:
    """An order of the examples (columns): by which of some that lie far apart they are most like."""
    best, nearest, pivot = np.full(head.shape[1], -1.0), np.zeros(head.shape[1], np.int64), 0
    for i in range(min(PIVOTS, head.shape[1])):
        cos = head[:, pivot] @ head
        nearest[cos > best] = i
        best = np.maximum(best, cos)
        pivot = int(best.argmin())
    return np.lexsort((-best, nearest))


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model, or the one score of all texts where the labels don't allow one. ``labels``: (doc_id, toxic) to learn from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "toxic")
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2").select("doc_id", F.col("y").cast("int").alias("y"))
    known = known.join(docs.where("doc_id is not null and text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return float(1 in total)
    shares = {y: n / sum(total.values()) for y, n in total.items()}
    picks = [known.where(F.col("y") == y).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(MAX_EXAMPLES).select("doc_id", "y").collect() for y in (0, 1)]
    sample = spark.createDataFrame([(r.doc_id, r.y) for p in picks for r in p], "id long, y int")  # at most 2 * MAX_EXAMPLES rows
    rows = materialise(docs.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("id", "y", F.col("text").cast("string").alias("text")).groupBy("id", "y").agg(F.min("text").alias("text")), "sample")

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(term_hashes(list(texts(batch.column("text"))))[0])
            yield pa.RecordBatch.from_arrays([pa.array(found[found > 0].view(np.int64))], ["term"])

    keys = rows.mapInArrow(terms_of, "term long").distinct().toArrow().column("term").to_numpy().astype(np.int64)  # those of 2 * MAX_EXAMPLES texts
    terms = Vocabulary(np.sort(keys.view(np.uint64)))
    held = spark.sparkContext.broadcast(terms)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = held.value, np.zeros(len(held.value) + 1, np.int64)  # the last counts the texts
        for batch in released(batches):
            every = list(texts(batch.column("text")))
            n[-1] += len(every)
            for a, b in pieces([len(t) for t in every], PIECE_BYTES):
                n[:-1] += np.bincount(known.count(every[a:b])[2], minlength=len(known))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    counts = docs.where("text is not null").select(F.col("text").cast("string").alias("text")).mapInArrow(present, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1)
    df[counts.column("term").to_numpy()] = counts.column("n").to_numpy()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, y, text in zip(batch.column("id").to_pylist(), batch.column("y").to_pylist(), texts(batch.column("text")), strict=True):
                _, _, term, n = held.value.count([text])
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((i, pa.int64()), (y, pa.int32()), (term, pa.list_(pa.int32())), (n, pa.list_(pa.int32())))], ["id", "y", "term", "n"])

    found = rows.mapInArrow(counted, "id long, y int, term array<int>, n array<int>").toArrow().sort_by("id").combine_chunks()  # at most 2 * MAX_EXAMPLES rows
    term, n = (found.column(c).combine_chunks() for c in ("term", "n"))
    example = np.repeat(np.arange(len(term)), np.diff(term.offsets.to_numpy()))
    model = build(terms, df[:-1], int(df[-1]), found.column("id").to_numpy(), found.column("y").to_numpy(), (example, term.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy()), shares)
    del found, term, n, example, counts, df
    calibrate(model, rows)
    give_back()
    return model


@keeps_columns("text")
def score(docs: DataFrame, model: Model | float, evidence: bool = False) -> DataFrame:
    """``docs`` with tox_score and, if asked for, tox_evidence: the nearest examples (id, cosine, label)."""
    schema = docs.withColumns({"tox_score": F.lit(0.0), **({"tox_evidence": F.expr("cast(null as array<struct<id:bigint,cosine:double,label:int>>)")} if evidence else {})}).schema
    if isinstance(model, float):
        return docs.withColumns({f.name: F.lit(model if f.name == "tox_score" else None).cast(f.dataType) for f in schema.fields[len(docs.columns) :]})
    held, curve = model.share(docs.sparkSession), model.curve
    for f in schema.fields:
        f.nullable = True
    kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        none = probability(np.tile(m.votes(np.zeros(0, np.int64), np.zeros(0)), 2), curve)
        for batch in released(batches):
            out, why = [], []
            every = list(texts(batch.column("text").cast(pa.string())))
            for a, b in pieces([len(t) for t in every], PIECE_BYTES):
                counts = m.terms.count(every[a:b], PART_WORDS)
                known = np.bincount(counts[0][counts[1]], minlength=b - a) > 0
                for i, (votes, ids, cos) in enumerate(m.evidence(*counts)):
                    out.append(probability(votes, curve) if known[i] else none)
                    if evidence:
                        why.append([{"id": int(m.ids[i]), "cosine": float(c), "label": int(m.labels[i])} for i, c in zip(ids[:5], cos[:5], strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64()), *([pa.array(why, kind)] if evidence else [])], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def training(spark, sf_dir: str) -> DataFrame:
    """Labels to learn from: those whose id is not in the held-out fold."""
    return table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(docs, fit(docs, training(spark, sf_dir)))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= CUTOFF).cast("int").alias("predicted"))
