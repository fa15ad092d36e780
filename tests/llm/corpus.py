"""Small tables with awkward rows, written as Parquet."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

WORDS = "the of and to in is that for with was on are by this from have not be at which".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + (str(r.randrange(400)) if r.random() < 0.5 else "") for _ in range(n))


def documents(seed=0, n=40):
    """(doc_id, text, lang, source, n_chars) with nulls, empty and long texts, copies, near copies and shared passages."""
    r = random.Random(seed)
    passage = prose(r, 80)
    rows = [[i, prose(r, r.randrange(8, 200)), "en", f"s{r.randrange(3)}"] for i in range(n)]
    for i in range(5, 9):
        rows[i][1] = rows[4][1]
    w = rows[10][1].split() + prose(r, 120).split()
    rows[10][1] = " ".join(w)
    for i in (11, 12):
        x = list(w)
        x[i] = f"changed{i}"
        rows[i][1] = " ".join(x)
    for i in (15, 16, 17):
        rows[i][1] = f"{prose(r, 30)} {passage} {prose(r, 30)}"
    rows[20][1], rows[21][1], rows[22][1], rows[23][1] = None, "", " \t\n", "é ß 日本語 one"
    rows[24][3], rows[25][2] = None, None
    rows[26][1] = prose(r, 12_000)
    rows[27][1] = "x" * 30_000
    rows[28][1] = "日本" * 3000
    return [(*x, len(x[1] or "")) for x in rows]


def write(folder, name, rows, names, types):
    cols = list(zip(*rows)) or [[] for _ in names]
    pq.write_table(pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, cols, types)}), f"{folder}/{name}.parquet")


DOCS = ["doc_id", "text", "lang", "source", "n_chars"]
DOC_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]


def write_documents(folder, rows=None):
    write(folder, "documents", documents() if rows is None else rows, DOCS, DOC_TYPES)


def clashing(df):
    """The frame with columns that have the names operators might use."""
    from pyspark.sql import functions as F

    names = ["id", "rep", "a", "b", "k", "c", "n", "row", "size", "target", "digest", "keeper", "block", "gone_id", "fm_items", "mix_size", "mix_source", "cdc_id", "tox_score", "held_out", "value"]
    return df.withColumns({x: F.lit(1) for x in names})
