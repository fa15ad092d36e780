"""Language of web pages by fusing evidence.

1. Text: hashed byte trigrams per language, counted over all labelled documents by grouped aggregation, give a page's
   visible text a log-likelihood per language, divided by ``DEPENDENCE`` because neighbouring trigrams aren't independent,
   nor are those of a long text, whose evidence grows with the root of their number in the end.
2. Markup: how often pages that read like a language declare each language is counted too, so that a declaration counts
   for as much as declarations have proved to be worth.
3. Address: host priors, smoothed towards the registered domain's, those towards the address suffix', and those towards
   the prior of all pages. A page's own share is taken out of its host's counts before they are used for it.

The evidence's sum gives posteriors. Counts of hosts, domains and suffixes are aggregates with map-side combining; the
host table is joined by a shuffle that Spark splits where a host is hot, or broadcast where Spark finds it small.

Defined results: a null or empty page has no text evidence, a null or unreadable url no host (those form one group);
without labelled documents the language is null and the probability 0; equal posteriors go to the first language by
name; repeated rows are pages each; columns other than page_id, url and html (lang and text in documents) are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, materialise, pieces, released, table, texts

BUCKETS = 1 << 15
DEPENDENCE = 3.0
#: From about so many trigrams on, the evidence of a text grows with the root of their number.
FULL_WEIGHT = 400
SMOOTHING = 0.5
#: Pages' worth of the upper level in the smoothing of a suffix, domain or host.
UPPER_WEIGHT = 4.0
PIECE_BYTES = 1 << 20
NO_DECLARATION = "none"
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)], np.uint32)
_MARKUP = re.compile(rb"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z!][A-Za-z0-9-]*)?[^<>]*>", re.S)
_END = {k: re.compile(rb"</%b\b[^<>]*>" % k, re.I) for k in (b"script", b"style")}
_DECLARED = re.compile(rb"<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)
_META = re.compile(rb"<meta\b[^<>]*?content-language[^<>]*?content\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def visible(html: bytes) -> bytes:
    """Text outside of tags, comments, scripts and styles. Linear in the length."""
    out, at = [], 0
    while m := _MARKUP.search(html, at):
        out.append(html[at : m.start()])
        at = m.end()
        if not m[1] and (end := _END.get((m[2] or b"").lower())):
            m = end.search(html, at)
            at = m.end() if m else len(html)
    out.append(html[at:])
    return b" ".join(out)


def declared(html: bytes) -> str | None:
    m = _DECLARED.search(html) or _META.search(html)
    return m[1].decode().lower()[:2] if m else None


def trigram_buckets(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each text and where each text begins in them; spaces in a row count once."""
    data = _LOWER[np.frombuffer(b"  ".join([b"", *group, b""]), np.uint8)]
    lengths = np.array([len(t) for t in group], np.int64)
    begin = np.cumsum(lengths + 2) - lengths
    h = (data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    keep = ~((data[:-2] == 0x20) & (data[1:-1] == 0x20)) & ~((data[1:-1] == 0x20) & (data[2:] == 0x20))
    place = np.cumsum(np.append(0, keep))
    return h[keep], place[np.minimum(begin - 1, len(h))]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (buckets, languages) log-probabilities, less their mean over languages

    def evidence(self, group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (texts, languages) and numbers of trigrams."""
        h, first = trigram_buckets(group)
        w = np.vstack([self.weights[h], np.zeros((1, len(self.langs)))])
        n = np.diff(np.append(first, len(h)))
        out = np.add.reduceat(w, np.minimum(first, len(h)), axis=0)
        out[n == 0] = 0
        return out / DEPENDENCE / np.sqrt(1 + n / FULL_WEIGHT)[:, None], n


def fit(labelled: DataFrame) -> Model:
    """From rows (lang, text). The model has ``BUCKETS`` numbers per language."""
    bounded_batches(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in released(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            every = list(texts(batch.column("text")))
            for lang in set(langs):
                own = [every[i] for i in np.flatnonzero(langs == lang)]
                for a, b in pieces([len(t) for t in own], PIECE_BYTES):
                    total[lang] = total.get(lang, 0) + np.bincount(trigram_buckets(own[a:b])[0], minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at].astype(np.int64))], ["lang", "bucket", "n"])

    rows = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per language and bucket
    names = np.array(found.column("lang").to_pylist(), object)
    langs = sorted(set(names))
    counts = np.zeros((BUCKETS, len(langs)))
    counts[found.column("bucket").to_numpy(), np.searchsorted(langs, names) if langs else np.zeros(0, np.int64)] = found.column("n").to_numpy()
    logs = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS))
    return Model(langs, logs - logs.mean(1, keepdims=True) if langs else logs)


def read_pages(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, host, domain, suffix, declared, n_trigrams, e0..): what a page says by itself; e are log-likelihoods."""
    k = len(model.langs)
    held = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            html = list(texts(batch.column("html")))
            shown = [visible(x) for x in html]
            found, n = np.zeros((len(html), k)), np.zeros(len(html), np.int64)
            for a, b in pieces([len(t) for t in shown], PIECE_BYTES):
                found[a:b], n[a:b] = held.value.evidence(shown[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([declared(x) for x in html], pa.string()), pa.array(n), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(k))], ["page_id", "url", "declared", "n_trigrams", *(f"e{i}" for i in range(k))])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.mapInArrow(read, "page_id long, url string, declared string, n_trigrams long, " + ", ".join(f"e{i} double" for i in range(k)))
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    known = F.col("declared").isin(*model.langs)
    return rows.withColumn("host", host).select("page_id", "host", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"), F.when(known, F.col("declared")).when(F.col("declared").isNull(), F.lit(NO_DECLARATION)).otherwise("other").alias("declared"), "n_trigrams", *(f"e{i}" for i in range(k)))


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    shares = [F.exp(x - top) for x in logs]
    total = sum(shares[1:], shares[0])
    return [x / total for x in shares]


def identify(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host, n_trigrams, posterior), a row per row of ``pages``."""
    langs, k = model.langs, len(model.langs)
    bounded_batches(pages.sparkSession)
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit("").alias("host"), F.lit(0).cast("long").alias("n_trigrams"), F.expr("cast(map() as map<string,double>)").alias("posterior"))
    read = materialise(read_pages(pages, model), "read-pages")
    e = [F.col(f"e{i}") for i in range(k)]
    read = read.withColumns({f"p{i}": x for i, x in enumerate(_softmax(e))})
    sums = lambda df, key, name: df.groupBy(key).agg(*(F.sum(f"p{i}").alias(f"{name}{i}") for i in range(k)))
    said = sums(read, "declared", "c").collect()  # a row per language, none and other
    total = {r.declared: [r[f"c{i}"] for i in range(k)] for r in said}
    all_of = [sum(c[i] for c in total.values()) for i in range(k)]
    pages_n = max(sum(all_of), 1e-9)
    prior = [(a + SMOOTHING) / (pages_n + SMOOTHING * k) for a in all_of]
    kinds = [*langs, NO_DECLARATION, "other"]
    likely = {d: [float(np.log((total.get(d, [0] * k)[i] + SMOOTHING) / (all_of[i] + SMOOTHING * len(kinds)))) for i in range(k)] for d in kinds}
    hosts = read.groupBy("host", "domain", "suffix").agg(*(F.sum(f"p{i}").alias(f"h{i}") for i in range(k)))
    domains = hosts.groupBy("domain").agg(*(F.sum(f"h{i}").alias(f"d{i}") for i in range(k)))
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(f"h{i}").alias(f"s{i}") for i in range(k)))
    levels = hosts.join(domains, "domain").join(suffixes, "suffix").drop("domain", "suffix")
    out = read.drop("domain", "suffix").join(levels, "host")
    upper: list[Column] = [F.lit(p) for p in prior]
    for name in "sdh":  # the suffix, then the domain, then the host
        own = [F.greatest(F.col(f"{name}{i}") - F.col(f"p{i}"), F.lit(0.0)) for i in range(k)]
        n = sum(own[1:], own[0]) + UPPER_WEIGHT
        upper = [(c + UPPER_WEIGHT * u) / n for c, u in zip(own, upper, strict=True)]
        out = out.withColumns({f"u{name}{i}": u for i, u in enumerate(upper)})
        upper = [F.col(f"u{name}{i}") for i in range(k)]
    says = [F.element_at(F.create_map(*(x for d in kinds for x in (F.lit(d), F.lit(likely[d][i])))), F.col("declared")) for i in range(k)]
    out = out.withColumns({f"q{i}": q for i, q in enumerate(_softmax([e[i] + says[i] + F.log(upper[i]) for i in range(k)]))})
    best = lambda name: F.array_max(F.array(*(F.struct(F.col(f"{name}{i}").alias("p"), F.lit(-i).alias("i")) for i in range(k))))
    names = F.array(*map(F.lit, langs))
    named = lambda x: F.element_at(names, F.lit(1) - x["i"])
    return out.select("page_id", named(best("q")).alias("lang"), best("q")["p"].alias("probability"), F.when(F.col("n_trigrams") > 0, named(best("p"))).alias("text_lang"), "declared", "host", "n_trigrams", F.map_from_arrays(names, F.array(*(F.col(f"q{i}") for i in range(k)))).alias("posterior"))


def query(spark, sf_dir: str) -> DataFrame:
    model = fit(table(spark, sf_dir, "documents"))
    return identify(table(spark, sf_dir, "pages"), model).select("page_id", "lang", "probability", "text_lang", "declared", "host", "n_trigrams")
