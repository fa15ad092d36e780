"""WARC archives: a writer with payload deduplication and a splittable reader.

Writer: records with equal payloads of ``min_revisit`` bytes or more share one response, that of the smallest page_id;
the others become revisit records that refer to it. Each task writes one archive, a gzip member per record, under a
temporary name and renames it when complete, so a task that runs again leaves the same file.

Reader: archives are cut into byte ranges. A task looks for gzip's magic bytes in its range, takes a place for a member
only if the member's start decodes to a WARC header, and owns the records that start inside its range, reading the last
one past the end. After a member it goes on at that member's end; where nothing valid starts there, it searches again.
Records of every type and digest are read: a member counts by its header and length, and whether its digest is right is a
column of its own.

Archives lie in the shared folder and are opened by URI through pyarrow's file systems.

Defined results: null html is an empty payload; a null url is written as an empty target; rows repeated with the same
page_id and payload are responses both; rows with null page_id are written and read back with null, and take part in
no sharing; an empty table writes no record and reads no row. Of records read, payload_digest is the SHA-256 of the payload,
and of revisits what they declare; digest_valid is null where no digest is declared or can be checked; page_id and
refers_to are null where the record's ids are not this writer's.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise, scratch, table

MIN_REVISIT = 100
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
MAX_HEADER = 1 << 16
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A read task goes through several ranges where there are more than so many.
READ_TASKS = 20_000
MEMBER_BYTES = 1 << 16
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, digest_valid boolean, payload binary"


def plan(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, owner): owner is null but for rows that revisit another page.

    Only digests that occur more than once are joined back, and rows without such a digest get a key of their own.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where((F.length("payload") >= min_revisit) & F.col("page_id").isNotNull())
    owners = large.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "owner")
    key = F.when((F.length("payload") >= min_revisit) & F.col("page_id").isNotNull(), F.col("digest")).otherwise(F.concat_ws(" ", F.lit("alone"), "page_id", F.xxhash64("payload")))
    joined = rows.withColumn("k", key).join(owners, F.col("k") == F.col("d"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("owner") < F.col("page_id"), F.col("owner")).alias("owner"))


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, owner: int | None) -> bytes:
    """One WARC record, not compressed. A revisit has the HTTP header of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if owner is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if owner is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=chr(37) + '!#$&()*+,/:;=?@[]~' + chr(39))}", f"WARC-Payload-Digest: sha256:{digest}"]
    if owner is not None:
        head += [f"WARC-Refers-To: {_uri(owner)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(rows: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes the rows of ``plan`` and returns (path, bytes, records), one row a file."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}.warc.gz"
        part, n, out = f"{name}.{task.taskAttemptId()}.tmp", 0, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "owner")]
            for row in zip(*cols, strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(part)
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(squeeze.compress(record(*row)) + squeeze.flush())
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            fs.move(part, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [n]})

    return rows.mapInArrow(put, "path string, bytes long, records long")


_HEADER = re.compile(rb"WARC/\d")


def _digest_valid(declared: str, payload: bytes) -> bool | None:
    """Whether the payload has the digest, in hex or base32; None for an unknown algorithm."""
    name, _, value = declared.partition(":")
    if name.lower().replace("-", "") not in ("md5", "sha1", "sha256", "sha512"):
        return None
    found = hashlib.new(name.lower().replace("-", ""), payload)
    return value.lower() == found.hexdigest() or value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("=")


def _parse(data: bytes) -> dict | None:
    """Fields of a decoded member, None unless it is a whole WARC record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not _HEADER.match(head):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    if not fields.get("content-length", "").isdigit() or len(rest) < (length := int(fields["content-length"])):
        return None
    kind, digest, payload, declared = fields.get("warc-type"), fields.get("warc-payload-digest", ""), rest[:length], None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        declared = re.search(rb"(?im)^Content-Length: *(\d+)", http)
    whole = kind != "revisit"
    number = lambda uri: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", uri)) else None
    return {
        "page_id": number(fields.get("warc-record-id", "")), "url": fields.get("warc-target-uri"), "payload_bytes": len(payload) if whole or not declared else int(declared[1]),
        "payload_digest": hashlib.sha256(payload).hexdigest() if whole else digest.removeprefix("sha256:"), "record_type": kind, "refers_to": number(fields.get("warc-refers-to", "")),
        "record_id": fields.get("warc-record-id"), "digest_valid": _digest_valid(digest, payload) if whole and digest else None, "payload": payload if whole else None,
    }


class _Range:
    """Buffered reading of a file from a place on."""

    def __init__(self, file, at: int, size: int):
        self.file, self.start, self.size, self.buf, self.pos = file, at, size, b"", 0

    @property
    def at(self) -> int:
        return self.start + self.pos

    def fill(self, n: int) -> bool:
        """Have n bytes from the place on in the buffer if the file has them."""
        while (have := len(self.buf) - self.pos) < n and self.start + len(self.buf) < self.size:
            more = self.file.read_at(min(READ_BYTES, self.size - self.at - have), self.at + have)
            self.start, self.buf, self.pos = self.at, self.buf[self.pos :] + more, 0
        return len(self.buf) - self.pos >= n

    def peek(self, skip: int, n: int) -> bytes:
        return self.buf[self.pos + skip : self.pos + skip + n]

    def skip(self, n: int) -> None:
        self.pos += n


def _member(src: _Range) -> tuple[bytes, int] | None:
    """The decoded member at the reader's place and its compressed size; None if none starts there."""
    d, out, used = zlib.decompressobj(31), [], 0
    try:
        head = b""
        while not d.eof:
            if not src.fill(used + 1):
                return None
            block = src.peek(used, MEMBER_BYTES)
            part = d.decompress(block)
            used += len(block) - len(d.unused_data)
            out.append(part)
            if len(head) < 5:
                head += part[:5]
                if not b"WARC/".startswith(head[:5]):
                    return None
    except zlib.error:
        return None
    return b"".join(out), used


def read_range(file, start: int, end: int, size: int) -> Iterator[dict]:
    """Records that start in [start, end)."""
    src = _Range(file, start, size)
    while src.at < end:
        src.fill(len(MAGIC))
        if src.peek(0, len(MAGIC)) == MAGIC and (found := _member(src)) and (row := _parse(found[0])):
            src.skip(found[1])
            yield row
            continue
        src.fill(MEMBER_BYTES)
        at = src.buf.find(MAGIC, src.pos + 1)
        left = len(src.buf) - src.pos
        if not left:
            return
        src.skip(at - src.pos if at >= 0 else max(1, left - len(MAGIC) + 1))


def read(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """One row per record of the archives (path, bytes), read in ranges of ``split_bytes``."""
    columns = [c.split()[0] for c in RECORD.split(", ")]
    columns = columns if payloads else columns[:-1]
    schema = RECORD if payloads else RECORD.rpartition(", ")[0]
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    splits = files.where("bytes > 0").select("path", F.explode(starts).alias("start"), F.col("bytes").alias("size"))
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, "size").alias("stop"), "size")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        for batch in batches:
            for path, start, end, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for row in read_range(file, start, end, size):
                        rows.append(row)
                        held += 200 + (len(row["payload"] or b"") if payloads else 0)
                        if held > READ_BYTES * 8:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(columns, kinds, strict=False)], columns)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(columns, kinds, strict=False)], columns)

    return splits.repartition(max(1, min(splits.count(), READ_TASKS))).mapInArrow(scan, schema)


def archive(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> tuple[str, DataFrame]:
    """Writes the archives of ``pages``; the folder, and (path, bytes, records) of each file, as a table beside them."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return folder, materialise(write(plan(pages, min_revisit), folder), "manifest")


def query(spark, sf_dir: str) -> DataFrame:
    folder, files = archive(table(spark, sf_dir, "pages"))
    return read(files, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
o AS (SELECT digest, min(page_id) AS owner FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN n >= 100 AND owner < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND owner < page_id THEN owner END AS refers_to
FROM d LEFT JOIN o ON d.digest = o.digest AND d.n >= 100
"""
