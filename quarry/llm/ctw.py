"""Scoring texts by context-tree weighting over bytes.

A text is its tokens in lower case, each followed by a space, and an end byte instead of the last space. Each byte is eight
binary decisions; each decision's node has a tree of contexts, the up to ``DEPTH`` bytes before. A context's counts give a
Krichevsky-Trofimov estimate, and the weighted probability of a context is half its own estimate and half the product
of its one-byte longer contexts. A decision's probability then mixes the estimates of all depths, each by the weight
that its context has won in training. The model is frozen for scoring.

How it is distributed: a task packs the texts that it reads into blocks of about ``BLOCK_BYTES``. A block's distinct grams
(context and byte, in 64 bits) and distinct words with their counts in training texts are dealt by hash and summed. The
grams are regrouped by their last two context bytes, below which the trees are independent; what is above has at most
65,280 nodes and is the only part that meets on the driver. Each block then gets back the log-probabilities of just its
own grams (in half precision) and the counts of its own words. No table of the whole model is ever held in one place.
A task deals into at most ``FAN`` parts; more take further levels, digit by digit of the part's number, between which the
rows of some ``FAN`` senders become those of one. So a block's worth of text makes a bounded number of rows at any size.

Defined results: a null or empty text is the end token alone; rows with null doc_id fall into the fold of the empty
id and are scored like others; repeated rows are trained on and scored each; other columns are not read. Without
any training text, all estimates are even: a byte costs eight bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, fold, materialise, pieces, released, table, texts
from quarry.llm.shingles import mix, word_hashes

DEPTH = 6
BLOCK_BYTES = 32 << 20
#: Bytes of text per part that grams and words are dealt into.
PART_BYTES = 24 << 20
#: Parts that one task deals into.
FAN = 256
PIECE_BYTES = 1 << 20
END = b"\n"
#: Key of the end token among the words' hashes.
END_KEY = np.uint64(0x0123456789ABCDEF)
GRAMS, WORDS = 0, 1
_HALF = np.log(0.5)


def stream(text: bytes) -> bytes:
    """The bytes that are scored: tokens in lower case, parted by spaces, and the end."""
    return b" ".join(text.lower().split()) + END


def gram_keys(streams: list[bytes]) -> np.ndarray:
    """For each byte of the streams, its context and itself in one number; before a stream, there are end bytes."""
    lead = END * DEPTH
    data = np.frombuffer(b"".join([lead + s for s in streams]), np.uint8)
    key = np.zeros(len(data) - DEPTH, np.uint64)
    for j in range(DEPTH + 1):
        key = (key << np.uint64(8)) | data[j : j + len(key)]
    keep = np.ones(len(key), bool)
    at = np.cumsum([len(s) + DEPTH for s in streams])[:-1]  # the next stream's lead begins here
    for j in range(DEPTH):
        keep[at - DEPTH + j] = False
    return key[keep]


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys)
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tally(np.concatenate([k for k, _ in parts] or [np.zeros(0, np.uint64)]), np.concatenate([c for _, c in parts] or [np.zeros(0, np.int64)]))


def _block_keys(all_texts: list[bytes], train: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct grams and words of a block, with their counts in training texts. A few pieces at a time are merged."""
    found: dict[int, list] = {GRAMS: [], WORDS: []}
    for a, b in pieces([len(t) for t in all_texts], PIECE_BYTES):
        for learn in (False, True):
            group = [t for t, is_train in zip(all_texts[a:b], train[a:b], strict=True) if is_train == learn]
            if not group:
                continue
            for kind in (GRAMS, WORDS):
                keys = gram_keys([stream(t) for t in group]) if kind == GRAMS else np.append(word_hashes(group)[0], np.full(len(group), END_KEY))
                keys.sort()
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                found[kind].append((keys[first], (np.diff(np.append(first, len(keys))) * int(learn)).astype(np.int32)))
                if len(found[kind]) > 4:
                    found[kind] = [_distinct(found[kind])]
    return {kind: _distinct(parts) for kind, parts in found.items()}


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted keys, all of which the sorted keys have: in order, so that memory is read in order."""
    by = np.argsort(wanted)
    ordered = wanted[by]
    new = np.append(True, ordered[1:] != ordered[:-1])
    found = values[np.searchsorted(keys, ordered[new])]
    out = np.empty(len(wanted), values.dtype)
    out[by] = found[np.cumsum(new) - 1]
    return out


def _planes(x: np.ndarray) -> bytes:
    """An array byte by byte position, compressed: the high bytes of small numbers take next to nothing."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _flat(data: bytes, dtype: type) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.decompress(data), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_flat(data, np.uint64), dtype=np.uint64)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(parts)).astype(np.int64)


def _group_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """The part of a gram's last two context bytes."""
    return (mix((grams >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(parts)).astype(np.int64)


def _digits(parts: int) -> tuple[int, int]:
    """(base, levels): the least levels, then the least base of at most ``FAN``, that number so many parts."""
    levels = base = 1
    while FAN**levels < parts:
        levels += 1
    while base**levels < parts:
        base += 1
    return base, levels


def _deal(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places that fall into it in order), for the buckets that occur."""
    by = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(bucket[by]) != 0)) if len(by) else []
    for a, b in zip(first, [*first[1:], len(by)], strict=True):
        yield int(bucket[by[a]]), by[a:b]


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers, by shifting to 8 and more and Stirling's series."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    small = x < 8
    y = np.where(small, x, 8.0)
    for j in range(8):
        shift += np.log(y + j)
    z = np.where(small, x + 8, x)
    i = 1 / z
    series = i / 12 - i**3 / 360 + i**5 / 1260 - i**7 / 1680
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.where(small, shift, 0.0)


_KNOWN = 1 << 16
_half, _whole = lgamma(np.arange(_KNOWN) + 0.5), lgamma(np.arange(_KNOWN) + 1.0)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    n = n0 + n1
    i = [np.minimum(x, _KNOWN - 1).astype(np.int64) for x in (n0, n1, n)]
    out = _half[i[0]] + _half[i[1]] - _whole[i[2]]
    big = n >= _KNOWN
    if big.any():
        out[big] = lgamma(n0[big] + 0.5) + lgamma(n1[big] + 0.5) - lgamma(n[big] + 1.0)
    return out - np.log(np.pi)


class Tree:
    """The contexts of ``DEPTH`` to 2 bytes of some grams, and what the eight decisions' nodes hold in them.

    At each depth keys are the context, its most recent byte first, and the next byte; a decision's nodes are runs of keys
    with equal context and bits so far. The decisions are worked off one at a time, to bound memory.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        byte = grams & np.uint64(255)
        ctx = np.zeros(len(grams), np.uint64)
        for j in range(DEPTH):
            ctx = (ctx << np.uint64(8)) | ((grams >> np.uint64(8 * (j + 1))) & np.uint64(255))
        key = (ctx << np.uint64(8)) | byte
        self.order = np.argsort(key)  # of the grams
        self.keys, self.n, self.up = {DEPTH: key[self.order]}, {DEPTH: counts[self.order]}, {}
        for d in range(DEPTH - 1, 1, -1):
            longer = self.keys[d + 1]
            shorter = ((longer >> np.uint64(16)) << np.uint64(8)) | (longer & np.uint64(255))
            self.keys[d], self.n[d] = tally(shorter, self.n[d + 1])
            self.up[d + 1] = np.searchsorted(self.keys[d], shorter)  # of each longer key, the place of the shorter

    def decision(self, j: int) -> dict[int, tuple]:
        """By depth: node of each key, first key, ones, total, weighted log-probability, and own estimate's weight of each node."""
        out: dict[int, tuple] = {}
        for d in range(DEPTH, 1, -1):
            keys, n = self.keys[d], self.n[d]
            run = keys >> np.uint64(8 - j)
            new = np.append(True, run[1:] != run[:-1])
            node, first = np.cumsum(new) - 1, np.flatnonzero(new)
            total = np.add.reduceat(n, first)
            ones = np.add.reduceat(n * ((keys >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64), first)
            own = kt(total - ones, ones)
            if d == DEPTH:
                weighted, stay = own, np.ones(len(own))
            else:
                _, child, _, _, below, _ = out[d + 1]
                product = np.bincount(node[self.up[d + 1][child]], weights=below, minlength=len(own))
                weighted = np.logaddexp(own, product) + _HALF
                stay = np.exp(own + _HALF - weighted)
            out[d] = node, first, ones, total, weighted, stay
        return out


_TOP = "ctx long, j int, node long, ones long, n long, weighted double"


def top_rows(tree: Tree) -> Iterator[pa.RecordBatch]:
    """Sums over the two-byte contexts with one last byte in common: what depth 1 needs."""
    for j in range(8):
        _, first, ones, total, weighted, _ = tree.decision(j)[2]
        key = tree.keys[2][first]
        parent = ((key >> np.uint64(16)) << np.uint64(8)) | ((key & np.uint64(255)) >> np.uint64(8 - j))
        by = np.argsort(parent, kind="stable")
        p = parent[by]
        edge = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        sums = [np.add.reduceat(x[by], edge) for x in (ones, total, weighted)]
        yield pa.RecordBatch.from_arrays([pa.array((p[edge] >> np.uint64(8)).astype(np.int64)), pa.array(np.full(len(edge), j, np.int32)), pa.array((p[edge] & np.uint64(255)).astype(np.int64)), *map(pa.array, sums)], ["ctx", "j", "node", "ones", "n", "weighted"])


class Top:
    """Depths 1 and 0: estimates and weights by context and node."""

    def __init__(self, rows: list):
        self.one, self.stay = np.full((2, 256, 8, 128), 0.5), np.full((2, 256, 8, 128), 0.5)
        ones, n, product = (np.zeros((256, 8, 128)) for _ in range(3))
        for r in rows:
            ones[r.ctx, r.j, r.node], n[r.ctx, r.j, r.node], product[r.ctx, r.j, r.node] = r.ones, r.n, r.weighted
        weighted = self._depth(1, ones, n, product)
        self._depth(0, ones.sum(0)[None], n.sum(0)[None], weighted.sum(0)[None])

    def _depth(self, depth: int, ones: np.ndarray, n: np.ndarray, product: np.ndarray) -> np.ndarray:
        own = kt(n - ones, ones)
        weighted = np.logaddexp(own, product) + _HALF
        self.one[depth, : len(ones)], self.stay[depth, : len(ones)] = (ones + 0.5) / (n + 1), np.exp(own + _HALF - weighted)
        return weighted

    def at(self, depth: int, ctx: np.ndarray, byte: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        c = ctx.astype(np.int64) if depth else np.zeros(len(ctx), np.int64)
        node = (byte >> np.uint64(8 - j)).astype(np.int64)
        one = self.one[depth, c, j, node]
        return np.where((byte >> np.uint64(7 - j)) & np.uint64(1), one, 1 - one), self.stay[depth, c, j, node]


def log2_probabilities(tree: Tree, top: Top) -> np.ndarray:
    """For each gram, the log2 of its last byte's probability after the bytes before it."""
    keys = tree.keys[DEPTH]
    byte, recent = keys & np.uint64(255), (keys >> np.uint64(8 * DEPTH)) & np.uint64(255)
    out = np.zeros(len(keys))
    for j in range(8):
        levels = tree.decision(j)
        bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        place, p = np.arange(len(keys)), None
        for d in range(DEPTH, 1, -1):
            if d < DEPTH:
                place = tree.up[d + 1][place]
            node, _, ones, total, _, stay = levels[d]
            i = node[place]
            one = ((ones + 0.5) / (total + 1.0))[i]
            own = np.where(bit, one, 1 - one)
            p = own if p is None else stay[i] * own + (1 - stay[i]) * p
        for d in (1, 0):
            own, stay = top.at(d, recent, byte, j)
            p = stay * own + (1 - stay) * p
        out += np.log2(p)
    back = np.empty(len(out))
    back[tree.order] = out
    return back


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _table(batch_or_table, names: list[str]) -> list[list]:
    return [batch_or_table.column(n).to_pylist() for n in names]


def score(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (fold(F.col("doc_id"), folds) == held_out).alias("held_out"))
    bounded_batches(docs.sparkSession)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 50), F.lit(0)).alias("s")).first().s
    base_of_parts, levels = _digits(max(1, -(-size // PART_BYTES)))
    parts = base_of_parts**levels

    def dealt(bucket: np.ndarray, level: int) -> Iterator[tuple[int, np.ndarray]]:
        """By the first ``level`` digits of the part's number."""
        return _deal(bucket // base_of_parts ** (levels - level))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's rows: one with its documents, compressed, and one for each part with its keys and counts."""
        kept, held = [], 0

        def block():
            name = uuid.uuid4().hex
            t = pa.Table.from_batches(kept)
            found = _block_keys([x for c in t.column("text").chunks for x in texts(c)], ~np.array(t.column("held_out").to_pylist(), bool))
            out = [(name, kind, p, _pack(k[at]), _planes(c[at].astype(np.int32)), None) for kind, (k, c) in found.items() for p, at in dealt(_part_of(k, parts), 1)]
            out.append((name, None, None, None, None, _packed(t)))
            for row in out:
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "kind", "part", "keys", "counts", "packed"])

        for batch in released(batches):
            for a, b in pieces([n or 0 for n in pc.binary_length(batch.column("text")).to_pylist()], BLOCK_BYTES):
                part = batch.slice(a, b - a)
                kept.append(part)
                held += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held >= BLOCK_BYTES:
                    yield from block()
                    kept, held = [], 0
        if kept:
            yield from block()

    asked = materialise(rows.mapInArrow(collect, "block string, kind int, part int, keys binary, counts binary, packed binary"), "asked")
    wanted = [asked.where("kind is not null").select("block", "kind", "part", "keys", "counts")]

    def merged(level: int):
        def merge(t: pa.Table) -> pa.Table:
            """Some senders' rows of the same digits as one sender's, by one digit more."""
            kind, width = t.column("kind")[0].as_py(), np.int32 if level == 1 else np.int64
            keys, counts = _distinct([(_unpack(k), _flat(c, width).astype(np.int64)) for k, c in zip(*_table(t, ["keys", "counts"]), strict=True)])
            out = [(t.column("into")[0].as_py(), kind, p, _pack(keys[at]), _planes(counts[at])) for p, at in dealt(_part_of(keys, parts), level + 1)]
            return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "kind", "part", "keys", "counts"), zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})

        return merge

    senders = asked.where("kind is null").count() if levels > 1 else 0
    for level in range(1, levels):
        senders = -(-senders // base_of_parts)
        wanted[-1] = wanted[-1].withColumn("into", F.concat_ws("/", "kind", "part", F.pmod(F.xxhash64("block"), F.lit(senders))))
        wanted.append(materialise(wanted[-1].groupBy("into").applyInArrow(merged(level), "block string, kind int, part int, keys binary, counts binary"), "asked"))

    def split(level: int, bucket_of, width: type):
        def deal_on(t: pa.Table) -> pa.Table:
            keys = np.concatenate([_unpack(k) for k in t.column("keys").to_pylist()])
            values = np.concatenate([_flat(v, width) for v in t.column("vals").to_pylist()])
            by = np.argsort(keys)
            keys, values = keys[by], values[by]
            out = [(t.column("src")[0].as_py(), p, _pack(keys[at]), _planes(values[at])) for p, at in dealt(bucket_of(keys, parts), level + 1)]
            return pa.table({n: pa.array(c, k) for n, c, k in zip(("src", "part", "keys", "vals"), zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)})

        return deal_on

    def routed(rows: DataFrame, bucket_of, width: type) -> DataFrame:
        """Rows (src, part, keys, vals) with distinct keys, dealt by one digit so far, by all digits."""
        sources = parts
        for level in range(1, levels):
            sources = -(-sources // base_of_parts)
            rows = rows.withColumn("src", F.pmod(F.xxhash64("src"), F.lit(sources))).groupBy("part", "src").applyInArrow(split(level, bucket_of, width), "src long, part int, keys binary, vals binary")
        return rows

    def total(t: pa.Table) -> pa.Table:
        """Sums of a part; grams are dealt anew by their last two context bytes."""
        kind, part = t.column("kind")[0].as_py(), t.column("part")[0].as_py()
        width = np.int32 if levels == 1 else np.int64
        keys, counts = _distinct([(_unpack(k), _flat(c, width).astype(np.int64)) for k, c in zip(*_table(t, ["keys", "counts"]), strict=True)])
        shares = dealt(_group_of(keys, parts), 1) if kind == GRAMS else [(part, slice(None))]
        out = [(kind, part, p, _pack(keys[at]), _planes(counts[at]), int(counts[at].sum()), int((counts[at] > 0).sum())) for p, at in shares]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("kind", "src", "part", "keys", "vals", "total", "seen"), zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)})

    summed = materialise(wanted[-1].select("kind", "part", "keys", "counts").groupBy("kind", "part").applyInArrow(total, "kind int, src long, part int, keys binary, vals binary, total long, seen long"), "summed")
    n = summed.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("seen"), F.lit(0)).alias("v")).first()

    def grams_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _distinct([(_unpack(k), _flat(c, np.int64)) for k, c in zip(*_table(t, ["keys", "vals"]), strict=True)])

    def top_of(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(top_rows(Tree(*grams_of(t))))

    grams = routed(summed.where(F.col("kind") == GRAMS).select("src", "part", "keys", "vals"), _group_of, np.int64)
    if levels > 1:
        grams = materialise(grams, "grams")  # read twice
    nodes = grams.groupBy("part").applyInArrow(top_of, _TOP).groupBy("ctx", "j", "node").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"), F.sum("weighted").alias("weighted"))
    top = docs.sparkSession.sparkContext.broadcast(Top(nodes.collect()))  # 256 contexts with 255 nodes at most

    def price(t: pa.Table) -> pa.Table:
        keys, counts = grams_of(t)
        value = log2_probabilities(Tree(keys, counts), top.value).astype(np.float16)
        out = [(t.column("part")[0].as_py(), p, _pack(keys[at]), _planes(value[at])) for p, at in dealt(_part_of(keys, parts), 1)]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("src", "part", "keys", "vals"), zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)})

    priced = routed(grams.groupBy("part").applyInArrow(price, "src long, part int, keys binary, vals binary"), _part_of, np.float16)
    priced = priced.select(F.lit(GRAMS).alias("kind"), "part", "keys", F.col("vals").alias("values"))
    known = summed.where(F.col("kind") == WORDS).select("kind", "part", "keys", F.col("vals").alias("values"))

    def answer(wanted: pa.Table, model: pa.Table) -> pa.Table:
        """For each block that asks, the values of its keys, in its order."""
        kind = wanted.column("kind")[0].as_py()
        pairs = [(_unpack(k), _flat(v, np.float16 if kind == GRAMS else np.int64)) for k, v in zip(*_table(model, ["keys", "values"]), strict=True)]
        keys, values = np.concatenate([k for k, _ in pairs]), np.concatenate([v for _, v in pairs])
        by = np.argsort(keys)
        keys, values = keys[by], values[by]
        out = [_planes(values[np.searchsorted(keys, _unpack(k))]) for k in wanted.column("keys").to_pylist()]
        return pa.table({"block": wanted.column("block"), "kind": wanted.column("kind"), "part": wanted.column("part"), "values": pa.array(out, pa.binary())})

    answers = wanted[-1].select("block", "kind", "part", "keys").groupBy("kind", "part").cogroup(priced.unionByName(known).groupBy("kind", "part")).applyInArrow(answer, "block string, kind int, part int, values binary")

    def handed(level: int):
        def hand(askers: pa.Table, got: pa.Table) -> pa.Table:
            """For each sender whose rows were merged, the values of its keys out of the values of all."""
            kind, own = askers.column("kind")[0].as_py(), [_unpack(k) for k in askers.column("keys").to_pylist()]
            keys = np.unique(np.concatenate(own))
            values, replies = np.zeros(len(keys), np.float16 if kind == GRAMS else np.int64), dict(zip(*_table(got, ["part", "values"]), strict=True))
            for p, at in dealt(_part_of(keys, parts), level + 1):
                values[at] = _flat(replies[p], values.dtype)
            return pa.table({"block": askers.column("block"), "kind": askers.column("kind"), "part": askers.column("part"), "values": pa.array([_planes(values[np.searchsorted(keys, k)]) for k in own], pa.binary())})

        return hand

    for level in range(levels - 1, 0, -1):
        answers = wanted[level - 1].select("into", "block", "kind", "part", "keys").groupBy("into").cogroup(answers.groupBy("block")).applyInArrow(handed(level), "block string, kind int, part int, values binary")
    n_train, v_train = int(n.n), int(n.v)

    def apply(packed: pa.Table, got: pa.Table) -> pa.Table:
        own = _unpacked(packed.column("packed")[0].as_py())
        all_texts = [x for c in own.column("text").chunks for x in texts(c)]
        keys = {kind: k for kind, (k, _) in _block_keys(all_texts, np.zeros(len(all_texts), bool)).items()}
        values = {}
        replies = {(k, p): v for k, p, v in zip(*_table(got, ["kind", "part", "values"]), strict=True)}
        for kind, dtype in ((GRAMS, np.float16), (WORDS, np.int64)):
            values[kind] = np.zeros(len(keys[kind]), dtype)
            for p, at in dealt(_part_of(keys[kind], parts), 1):
                values[kind][at] = _flat(replies[kind, p], dtype)
        bits, base, tokens, seen, n_bytes = [], [], [], [], []
        for a, b in pieces([len(t) for t in all_texts], PIECE_BYTES):
            group = all_texts[a:b]
            streams = [stream(t) for t in group]
            lengths = np.array([len(s) for s in streams])
            cost = look_up(keys[GRAMS], values[GRAMS], gram_keys(streams)).astype(np.float64)
            bits.append(np.add.reduceat(cost, np.cumsum(lengths) - lengths))
            n_bytes.append(lengths)
            h, first = word_hashes(group)
            h = np.insert(h, first[1:], END_KEY)
            first = first + np.arange(len(first))
            count = look_up(keys[WORDS], values[WORDS], h)
            cost = np.log10((count + 0.5) / (n_train + 0.5 * (v_train + 1)))
            tokens.append(np.diff(first))
            seen.append(np.add.reduceat((count > 0).astype(np.int64), first[:-1]))
            base.append(np.add.reduceat(cost, first[:-1]))
        bits, n_bytes = np.concatenate(bits), np.concatenate(n_bytes)
        return pa.table({"doc_id": own.column("doc_id"), "held_out": own.column("held_out"), "n_tokens": np.concatenate(tokens), "n_known": np.concatenate(seen), "train_tokens": np.full(len(bits), n_train), "base_score": np.concatenate(base), "score": bits * np.log10(2.0), "bits_per_byte": -bits / n_bytes})

    return asked.where("packed is not null").select("block", "packed").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
