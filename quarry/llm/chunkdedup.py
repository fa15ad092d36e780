"""Removal of repeated passages by content-defined chunking.

A gear hash rolls over the last ``SPAN`` bytes. A chunk ends before a word if the hash of what precedes is below ``CUT``, or
before any character if it is below ``RARE_CUT`` (for texts without spaces), so boundaries follow the content and an
insertion only changes the chunks it touches. Where one word stands again and again, the hash stays the same and might
never cut, so a chunk also ends after a word that equals the word before it. Chunks are known by a 64-bit digest. The document with the smallest id that
has a chunk keeps it, within a document its first place does; of the others, runs of neighbouring repeated chunks with
``MIN_WORDS`` words or more are cut out of the text. A repeated passage loses a part of a chunk at each end to its
surroundings, so a run of this length stands for a passage that is about 13 words longer. In words of over ``LONG_WORD`` bytes, every
``LETTERS`` bytes beyond ASCII count as one more, for scripts without spaces.

A row per distinct digest and document is written once and aggregated with map-side combining, and only digests that occur again
are joined back, so a chunk that a third of all documents share is split by Spark's handling of skewed joins. What repeats and each
document's list are tables of their own; chunks and their shuffles are deleted before the texts are shuffled to the lists.

Defined results: null and empty texts stay as they are; rows with null doc_id stay as they are and lend nothing; rows
repeated with one doc_id are one document, and each keeps its chunks' first places; all columns but text are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, discard, keeps_columns, materialise, pieces, released, shuffles_dropped, table, texts
from quarry.llm.shingles import PIECE_BYTES, mix, powers

SPAN = 16
CUT = (1 << 32) // 5
RARE_CUT = (1 << 32) // 256
MAX_CHUNK = 1024
MIN_WORDS = 20
LONG_WORD, LETTERS = 48, 12
_ASCII = bytes(range(128))
GEAR = np.random.default_rng(20240510).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2h + G[byte] over the last ``SPAN`` bytes up to each place, by doubling."""
    h, w = GEAR[data], 1
    while w < SPAN:
        longer = h.copy()
        longer[w:] += h[:-w] << np.uint32(w)
        h, w = longer, 2 * w
    return h


def chunk_all(group: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of several texts: the text's number, start and end within it, digest."""
    lengths = np.array([len(t) for t in group], np.int64)
    begin = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(group), np.uint8)
    if not len(data):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h, space = gear(data), _SPACE[data]
    cut = np.zeros(len(data), bool)  # a chunk begins here
    cut[1:] = ((h[:-1] < CUT) & space[:-1] & ~space[1:]) | ((h[:-1] < RARE_CUT) & ((data[1:] & 0xC0) != 0x80))
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    full = lengths > 0
    for j in range(SPAN):  # the hash would reach into the text before
        at = begin[full] + j
        cut[at[at < begin[full] + lengths[full]]] = j == 0
    words = np.zeros(len(data), bool)
    words[1:] = space[:-1] & ~space[1:]
    words[begin[full]] = True
    at = np.flatnonzero(words)
    word = (sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]]  # with the space behind it
    text = np.searchsorted(begin[full], at, side="right")
    again = (word[1:] == word[:-1]) & (np.diff(at)[1:] == np.diff(at)[:-1]) & (text[2:] == text[:-2]) if len(at) > 2 else np.zeros(0, bool)
    cut[at[2:][again]] = True
    starts = np.flatnonzero(cut)
    gaps = np.diff(np.append(starts, len(data)))
    if (gaps > MAX_CHUNK).any():
        more = [np.arange(s + MAX_CHUNK, s + g, MAX_CHUNK) for s, g in zip(starts[gaps > MAX_CHUNK], gaps[gaps > MAX_CHUNK], strict=True)]
        extra = np.concatenate(more)
        for _ in range(3):
            extra = np.where((data[np.minimum(extra, len(data) - 1)] & 0xC0) == 0x80, extra + 1, extra)
        starts = np.unique(np.concatenate([starts, extra[extra < len(data)]]))
    ends = np.append(starts[1:], len(data))
    digest = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    which = np.searchsorted(begin, starts, side="right") - 1
    return which, starts - begin[which], ends - begin[which], digest


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, n): each document's distinct chunks and how often it has them."""
    for batch in released(batches):
        every = list(texts(batch.column("text")))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for a, b in pieces([len(t) for t in every], PIECE_BYTES):
            which, _, _, digest = chunk_all(every[a:b])
            by = np.lexsort((digest, which))
            w, d = which[by], digest[by]
            first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (d[1:] != d[:-1]))) if len(w) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(w)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][w[first]].astype(np.int64)), pa.array(d[first].view(np.int64)), pa.array(n.astype(np.int64))], ["doc_id", "digest", "n"])


def size_in_words(text: bytes) -> int:
    return sum(1 + (len(w.translate(None, _ASCII)) // LETTERS if len(w) > LONG_WORD else 0) for w in text.split())


def repeated_spans(text: bytes, starts: np.ndarray, ends: np.ndarray, digest: np.ndarray, foreign: np.ndarray, own: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Byte spans to cut: runs of chunks that another document keeps (foreign) or that occurred before in this one (own)."""
    again = np.isin(digest, foreign)
    if len(own):
        mine = np.flatnonzero(np.isin(digest, own))
        _, first = np.unique(digest[mine], return_index=True)
        again[np.delete(mine, first)] = True
    if not again.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
    spans = [(int(starts[a]), int(ends[b - 1])) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return [(a, b) for a, b in spans if size_in_words(text[a:b]) >= min_words]


def _cut(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        every, out, at, removed = list(texts(batch.column("text"))), batch.column("text").to_pylist(), [[] for _ in range(batch.num_rows)], [0] * batch.num_rows
        foreign, own = batch.column("cdc_foreign"), batch.column("cdc_own")
        rows = [i for i in range(batch.num_rows) if (foreign[i].is_valid or own[i].is_valid) and every[i]]
        for a, b in pieces([len(every[i]) for i in rows], PIECE_BYTES):
            group = rows[a:b]
            which, starts, ends, digest = chunk_all([every[i] for i in group])
            first = np.searchsorted(which, np.arange(len(group) + 1))
            for k, i in enumerate(group):
                s = slice(first[k], first[k + 1])
                known = [x[i].values.to_numpy().view(np.uint64) if x[i].is_valid else np.zeros(0, np.uint64) for x in (foreign, own)]
                at[i] = repeated_spans(every[i], starts[s], ends[s], digest[s], *known, min_words)
                if at[i]:
                    t, last, left = every[i], 0, []
                    for x, y in at[i]:
                        left.append(t[last:x])
                        last = y
                    out[i] = b"".join([*left, t[last:]]).decode()
                    removed[i] = sum(y - x for x, y in at[i])
        new = {"text": pa.array(out, pa.string()), "cdc_starts": pa.array([[x for x, _ in s] for s in at], pa.list_(pa.int64())), "cdc_ends": pa.array([[y for _, y in s] for s in at], pa.list_(pa.int64())), "cdc_removed": pa.array(removed, pa.int64())}
        names = [n for n in batch.schema.names if n not in ("cdc_foreign", "cdc_own")]
        yield pa.RecordBatch.from_arrays([new.get(n, None) if n in new else batch.column(n) for n in names] + [new[n] for n in new if n not in names], names + [n for n in new if n not in names])


@keeps_columns("doc_id", "text")
def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of text, and cdc_starts, cdc_ends (byte spans cut) and cdc_removed (bytes)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = materialise(rows.where("doc_id is not null and text <> ''").mapInArrow(_rows, "doc_id long, digest long, n long"), "chunks")
    with shuffles_dropped(docs.sparkSession):
        again = materialise(chunks.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.sum("n").alias("total")).where("total > 1").select("digest", "keeper"), "again")
        found = chunks.join(again, "digest").where("keeper <> doc_id or n > 1")
        lists = materialise(found.groupBy(F.col("doc_id").alias("cdc_id")).agg(F.collect_list(F.when(F.col("keeper") != F.col("doc_id"), F.col("digest"))).alias("cdc_foreign"), F.collect_list(F.when(F.col("keeper") == F.col("doc_id"), F.col("digest"))).alias("cdc_own")), "lists")
    discard(chunks)
    discard(again)
    joined = docs.withColumn("text", F.col("text").cast("string")).join(lists, F.col("doc_id") == F.col("cdc_id"), "left").drop("cdc_id")
    schema = docs.withColumns({"text": F.col("text").cast("string"), "cdc_starts": F.expr("cast(null as array<bigint>)"), "cdc_ends": F.expr("cast(null as array<bigint>)"), "cdc_removed": F.expr("cast(null as bigint)")}).schema
    for f in schema.fields:
        f.nullable = True
    return joined.mapInArrow(lambda b: _cut(b, min_words), schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("cdc_removed").alias("removed_bytes"), F.size("cdc_starts").cast("long").alias("removed_spans"), "text")
