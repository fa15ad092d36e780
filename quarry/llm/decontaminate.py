"""Benchmark decontamination with an FM-index per shard of the training texts.

A task reads its documents as word ids, cuts them into shards of at most ``shard_words`` words and builds over each
shard a suffix order, the Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled by text position.
Benchmark windows are searched backward, a block of them at once; occurrences are located by walking to a sampled position,
and their spans are merged per document. A longer document spans several shards that overlap by a window less one word.
Nothing is shuffled. Windows reach the tasks in blocks of at most ``block_windows`` windows and ``block_bytes`` bytes, each a
broadcast of its own. A shard is indexed once, with ids of its own for its words; then the task goes through the blocks and
holds one of them at a time, so that the benchmark's size has no limit either.

Defined results: a null or empty text has no words and is clean; an empty item, a null item text and an item without id
have no windows; repeated items count by item_id once; repeated documents give a row each; columns beside doc_id and
text (item_id and text in the benchmark) are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, keeps_columns, released, table, texts

WINDOW = 8
SHARD_WORDS = 500_000
BLOCK_WINDOWS = 200_000
BLOCK_BYTES = 64 << 20
SAMPLE_EVERY = 8
MIN_ITEMS = 2
#: Bytes that are no part of a word become spaces, A-Z become a-z.
SEPARATED = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(SEPARATED).split()


def item_windows(text: bytes, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else []


def suffix_order(ids: np.ndarray, sigma: int) -> np.ndarray:
    """Positions of ``ids`` in the order of the suffixes that start there. Beyond the end, the id is 0.

    The first key packs as many ids as fit 62 bits; after that, prefixes double, and only suffixes still tied are sorted.
    """
    n = len(ids)
    bits = max(1, int(sigma - 1).bit_length())
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([ids.astype(np.int64), np.zeros(h, np.int64)])
    for j in range(h):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    first = np.flatnonzero(new)
    at = first[np.cumsum(new) - 1]  # of each place in the order, where its group begins
    rank = np.empty(n, np.int64)
    rank[order] = at
    sizes = np.diff(np.append(first, n))
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the order
    while len(tied):
        pos = order[tied]
        far = pos + h
        key = (rank[pos] << 32) | np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, pos = key[by], pos[by]
        order[tied] = pos
        new = np.empty(len(tied), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        first = np.flatnonzero(new)
        rank[pos] = tied[first[np.cumsum(new) - 1]]
        sizes = np.diff(np.append(first, len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


class FMIndex:
    """Backward search over an array of small ids, the last of which is its only 0, so that the walk from a place to the
    place of the suffix one position before is exact for all but position 0, and that one is sampled."""

    def __init__(self, ids: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        order = suffix_order(ids, sigma)
        self.n, self.bits = len(ids), max(1, int(sigma - 1).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=sigma))])
        marked = order % every == 0
        self.marked, self.marks, self.sampled = marked, np.concatenate([[0], np.cumsum(marked, dtype=np.int32)]), order[marked]
        seq = ids[order - 1]  # the id before each suffix
        self.zeros, self.ones = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            ones = np.empty(self.n + 1, np.int32)
            ones[0] = 0
            np.cumsum(bit, dtype=np.int32, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before each place i of the transform."""
        lo = np.zeros_like(i)
        for b, zeros, ones in zip(range(self.bits - 1, -1, -1), self.zeros, self.ones, strict=True):
            one = ((c >> b) & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            i = np.where(one, zeros + ones[i], i - ones[i])
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for zeros, ones in zip(self.zeros, self.ones, strict=True):
            one = ones[i + 1] > ones[i]
            i = np.where(one, zeros + ones[i], i - ones[i])
            c = (c << 1) | one
        return c

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For patterns in the rows, right-aligned: the range of places whose suffixes begin with them."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for j in range(width - 1, -1, -1):
            live = np.flatnonzero((lengths >= width - j) & (lo < hi))
            c = patterns[live, j].astype(np.int64)
            lo[live], hi[live] = self.before[c] + self.rank(c, lo[live]), self.before[c] + self.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at these places."""
        out, at, steps, todo = np.zeros(len(places), np.int64), places.copy(), 0, np.arange(len(places))
        while len(todo):
            done = self.marked[at]
            out[todo[done]] = self.sampled[self.marks[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            c = self.access(at)
            at = self.before[c] + self.rank(c, at)
            steps += 1
        return out


class Patterns:
    """A block of windows, as places in the list of their words."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], list[str]]], window: int):
        every = sorted({w for k, _ in windows for w in k})
        at = {w: i for i, w in enumerate(every)}
        self.words = pa.array(every, pa.large_binary())
        self.places = np.full((len(windows), window), len(every), np.int32)  # right-aligned; beyond the words: nothing
        self.lengths = np.array([len(k) for k, _ in windows], np.int64)
        for i, (k, _) in enumerate(windows):
            self.places[i, window - len(k) :] = [at[w] for w in k]
        self.items = pa.array([v for _, v in windows], pa.large_list(pa.large_string()))

    def of(self, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """The windows whose words are all known, and their ids."""
        ids = np.fromiter((vocabulary.get(w, -1) for w in (*self.words.to_pylist(), b"")), np.int64, len(self.words) + 1)
        ids[-1] = 0
        ids = ids[self.places]
        live = np.flatnonzero((ids >= 0).all(1))
        return live, ids[live]


def _each(blocks: list[Broadcast]) -> Iterator[Patterns]:
    """The blocks' windows; of several blocks, none stays in memory."""
    for held in blocks:
        yield held.value
        if len(blocks) > 1:
            vars(held).pop("_value", None)


def _scan(column: pa.Array, blocks: list[Broadcast], window: int, shard_words: int) -> tuple[list[int], list[list], list[set]]:
    """For each text its number of words, the list of (starts, ends) of windows that occur, and their items."""
    overlap = window - 1
    n_words: list[int] = []
    spans: list[list] = []
    items: list[set] = []
    shard: list[tuple[int, int, np.ndarray]] = []
    vocabulary: dict[bytes, int] = {}  # from 2 on; 0 ends a shard, 1 parts its texts
    filled = 0

    def flush():
        apart, parts, starts, at = np.ones(1, np.int32), [], [], 0
        for _, _, ids in shard:
            starts.append(at)
            parts += [ids, apart]
            at += len(ids) + 1
        index = FMIndex(np.concatenate([*parts, np.zeros(1, np.int32)]), len(vocabulary) + 2)
        for patterns in _each(blocks):
            live, ids = patterns.of(vocabulary)
            lo, hi = index.search(ids, patterns.lengths[live])
            which = np.repeat(live, hi - lo)
            if not len(which):
                continue
            first = np.cumsum(hi - lo) - (hi - lo)
            pos = index.locate(np.arange(len(which)) - np.repeat(first, hi - lo) + np.repeat(lo, hi - lo))
            by = np.argsort(pos)
            pos, which = pos[by], which[by]
            piece = np.searchsorted(starts, pos, side="right") - 1
            for p, s, w in zip(np.unique(piece), *(np.split(x, np.flatnonzero(np.diff(piece)) + 1) for x in (pos, which)), strict=True):
                row, offset, _ = shard[p]
                s = s - starts[p] + offset
                spans[row].append((s, s + patterns.lengths[w]))
                items[row].update(*patterns.items.take(pa.array(np.unique(w))).to_pylist())
        shard.clear()

    for row, text in enumerate(texts(column)):
        found = words(text)
        n_words.append(len(found))
        spans.append([])
        items.append(set())
        for begin in range(0, max(1, len(found) - overlap), shard_words) if found else ():
            part = found[begin : begin + shard_words + overlap]
            if shard and filled + len(part) > shard_words:
                flush()
                filled = 0
                vocabulary.clear()
            for w in set(part).difference(vocabulary):
                vocabulary[w] = len(vocabulary) + 2
            shard.append((row, begin, np.fromiter(map(vocabulary.__getitem__, part), np.int32, len(part))))
            filled += len(part)
    if shard:
        flush()
    return n_words, spans, items


def _annotate(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast], window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """The rows with fm_words, fm_starts, fm_ends and fm_items in place of fm_text."""
    for batch in released(batches):
        n_words, spans, items = _scan(batch.column("fm_text"), blocks, window, shard_words)
        merged = [_merge(found) if found else ([], []) for found in spans]
        new = {"fm_words": pa.array(n_words, pa.int64()), "fm_starts": pa.array([s for s, _ in merged], pa.list_(pa.int32())), "fm_ends": pa.array([e for _, e in merged], pa.list_(pa.int32())), "fm_items": pa.array([sorted(i) for i in items], pa.list_(pa.string()))}
        own = [c for c in batch.schema.names if c != "fm_text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, own), *new.values()], [*own, *new])


def _merge(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Union of half-open spans."""
    s, e = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    by = np.argsort(s, kind="stable")
    s, e = s[by], np.maximum.accumulate(e[by])
    new = np.append(True, s[1:] > e[:-1])
    return s[new].tolist(), e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)].tolist()


def _window_blocks(benchmark: DataFrame, window: int, block_windows: int, block_bytes: int) -> Iterator[Patterns]:
    """Windows with their items, in blocks; the driver holds one block at a time."""

    def cut(batches):
        for batch in batches:
            keys, ids = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), texts(batch.column("text")), strict=True):
                for k in dict.fromkeys(item_windows(text, window)):
                    keys.append(b" ".join(k))
                    ids.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.string())], ["k", "item"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "k binary, item string")
    block: dict[bytes, list[str]] = {}
    held = 0
    for row in rows.distinct().orderBy("k", "item").toLocalIterator():
        k = bytes(row.k)
        if len(block) >= block_windows or held >= block_bytes:  # a window of many items goes on in the next block
            yield Patterns([(tuple(x.split()), v) for x, v in block.items()], window)
            block, held = {}, 0
        block.setdefault(k, []).append(row.item)
        held += len(k) + len(row.item)
    yield Patterns([(tuple(x.split()), v) for x, v in block.items()], window)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int, block_windows: int, block_bytes: int, finish: Callable = lambda batches, scan: batches) -> DataFrame:
    """``docs`` with the columns that ``annotate`` names. ``finish`` goes over the batches in the same Python worker and may scan
    other texts."""
    bounded_batches(docs.sparkSession)
    schema = docs.withColumns({"fm_words": F.lit(0).cast("long"), "fm_starts": F.expr("cast(array() as array<int>)"), "fm_ends": F.expr("cast(array() as array<int>)"), "fm_items": F.expr("cast(array() as array<string>)")}).schema
    for f in schema.fields:
        f.nullable = True
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in _window_blocks(benchmark, window, block_windows, block_bytes)]
    return docs.withColumn("fm_text", F.col("text").cast("string")).mapInArrow(lambda b: finish(_annotate(b, blocks, window, shard_words), lambda column: _scan(column, blocks, window, shard_words)), schema)


@keeps_columns("text")
def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with fm_words (their number), fm_starts and fm_ends (merged word spans of the windows that occur) and fm_items."""
    return _found(docs, benchmark, window, shard_words, block_windows, block_bytes)


def query(spark, sf_dir: str) -> DataFrame:
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("fm_ends", "fm_starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    n_items = F.size("fm_items").cast("long")
    return found.select("doc_id", F.col("fm_words").alias("n_words"), n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.concat_ws(",", "fm_items").cast("binary"), 256).alias("items_sha256"), (n_items >= MIN_ITEMS).alias("contaminated"))


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without_spans(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without these spans of words; what stood between their words goes too."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, text[last:]])


def _cut(batches: Iterator[pa.RecordBatch], min_items: int, scan: Callable) -> Iterator[pa.RecordBatch]:
    """The rows with fewer items than that, without their spans; and without those that arise where words met by a cut."""
    for batch in batches:
        batch = batch.filter(pa.array([len(x) < min_items for x in batch.column("fm_items").to_pylist()], pa.bool_()))
        new = batch.column("text").to_pylist()
        found = {i: x for i, x in enumerate(zip(batch.column("fm_starts").to_pylist(), batch.column("fm_ends").to_pylist(), strict=True)) if x[0]}
        while found:
            for i, (starts, ends) in found.items():
                new[i] = without_spans(new[i].encode(), starts, ends).decode()
            rows = list(found)
            _, spans, _ = scan(pa.array([new[i] for i in rows], pa.large_string()))
            found = {i: _merge(x) for i, x in zip(rows, spans, strict=True) if x}
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)


@keeps_columns("text")
def clean(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """Documents with windows of ``min_items`` items or more go; from the others, the spans of the windows found are cut
    out, until none is left."""
    return _found(docs, benchmark, WINDOW, SHARD_WORDS, BLOCK_WINDOWS, BLOCK_BYTES, lambda batches, scan: _cut(batches, min_items, scan)).select(docs.columns)


SQL = r"""
WITH w AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, array_to_string(ws[i:i+7], ' ') AS k, least(len(ws), 8) AS l FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 7) + 1)) AS i FROM w WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
lengths AS (SELECT DISTINCT l FROM windows),
grams AS (SELECT row, i, l, array_to_string(ws[i:i+l-1], ' ') AS k FROM (SELECT row, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, lengths)),
hits AS (SELECT row, i, g.l, item_id FROM grams g JOIN windows USING (k, l)),
words AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + l)) AS p FROM hits) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""
