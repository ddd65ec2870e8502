"""WARC archives: writing with revisit records, and a splittable reader of gzip members.

Writer: a record a page; of equal payloads of at least `least` bytes the one with the largest page_id is the response, the others are revisits that name it
and carry digest and length but no payload. Each record is a gzip member of its own. A task writes one archive under a name of its own (partition, attempt,
random), and only archives of tasks that succeeded are listed, so a task that runs twice leaves at most an unlisted file.

Reader: the driver lists archives with their lengths (a row an archive) and cuts byte ranges; a task scans its range for the gzip magic, takes a place as a member
only if its header decodes to the begin of a WARC record, and owns the records that start inside its range, reading past the range's end to finish the last.
Compressed bytes that merely look like a member fail the decoding. A damaged member is skipped to the next that decodes; a range needs no other range.

Defined cases: null and empty html have an empty payload; null page_id is written as an empty field and read back as null, and never is the one referred to
(equal payloads of null ids only are all responses); ids that are no integers can be written but are read back as null; rows with equal id and payload are all responses if that id is the largest; null urls are written as
empty; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, Scratch, read_table

MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"  # a fixed date: reruns give equal archives
READ = 1 << 20


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it; Hadoop writes file:/x for file:///x."""
    return pyarrow.fs.FileSystem.from_uri("file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


# Writing

def decided(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages(page_id, url, html) with payload (binary), digest, bytes, record_type, refers_to. The largest id of a digest comes from an aggregation of narrow rows with a partial
    step; only digests that occur more than once are joined back. Rows that can't be revisits have a join key of their own, so they spread over all tasks, and the
    rows of a digest with more than their share (common.HOT: at most 1024 such digests) are dealt over several."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    spark = pages.sparkSession
    large = pages.where(F.octet_length(html) >= least).select("page_id", F.sha1(html).alias("digest"))
    first = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    first = Scratch(spark, "warc").cut(first, "first")
    share = max((first.agg(F.sum("n")).first()[0] or 0) * HOT, 16.0)
    hot = first.where(F.col("n") > share).select("digest", F.ceil(F.col("n") / share).cast("int").alias("parts"))
    table = first.join(F.broadcast(hot), "digest", "left").select(F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("digest").alias("key"), "first")
    p = pages.withColumn("payload", html).drop("html").withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    p = p.join(F.broadcast(hot), "digest", "left").withColumn("part", F.pmod(F.hash("page_id", "url"), F.coalesce("parts", F.lit(1))))
    key = F.when(F.col("bytes") >= least, F.col("digest")).otherwise(F.concat(F.lit("row "), F.monotonically_increasing_id()))
    p = p.withColumn("key", key).join(table, ["key", "part"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.select("page_id", "url", "payload", "digest", "bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers) -> bytes:
    uri = lambda i: f"<urn:page:{i}>"
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {uri('' if page_id is None else page_id)}", f"WARC-Target-URI: {clean}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {uri(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    else:
        head += ["Content-Type: text/html; charset=utf-8"]
        body = payload
    head += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8") + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, to: str, least: int = 1000) -> DataFrame:
    """Write pages(page_id, url, html) as archives under `to`; returns archives(path, bytes, records), one row an archive, already written."""
    d = decided(pages.select("page_id", "url", "html"), least)

    def run(batches):
        from pyspark import TaskContext

        task, out, n = TaskContext.get(), None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs, base = opened(to)
                    fs.create_dir(base, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member(record(row["page_id"], row["url"], row["payload"], row["digest"], row["bytes"], row["record_type"], row["refers_to"])))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{to}/{name}"], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return d.mapInArrow(run, "path string, bytes bigint, records bigint")


# Reading

@dataclass
class Record:
    headers: dict[str, str]
    body: bytes
    at: int


def inflated(read, at: int, most: int | None = None) -> tuple[bytes, int] | None:
    """The member that starts at `at` (read(at, n) gives bytes of the archive), whole and with its checksum right, or its first bytes, and the place behind it;
    None if it isn't one."""
    z, out, got = zlib.decompressobj(31), [], 0
    step = READ if most is None else 2048
    try:
        while not z.eof:
            data = read(at, step)
            if not data:
                return None
            at += len(data)
            out.append(z.decompress(data) if most is None else z.decompress(data, most - got))
            got += len(out[-1])
            if most is not None and got >= most:
                break
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def parsed(data: bytes, at: int) -> Record | None:
    head, found, body = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    lines = [x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
    headers = {k.strip().lower(): v.strip() for k, _, v in lines}
    size = headers.get("content-length", "")
    if not size.isdigit() or len(body) < int(size):
        return None
    return Record(headers, body[: int(size)], at)


def scan(read, start: int, stop: int):
    """Records whose member starts in [start, stop). Bytes are taken in blocks that overlap by the magic's length less one; behind a record the scan goes on at its
    member's end, behind a place that isn't one at the next byte."""
    at = start
    while at < stop:
        data = read(at, min(READ, stop - at) + len(MAGIC) - 1)
        i = data.find(MAGIC)
        if i < 0:
            if len(data) < READ:
                return
            at += len(data) - (len(MAGIC) - 1)
            continue
        at += i
        head = inflated(read, at, 7)
        whole = inflated(read, at) if head is not None and head[0].startswith(b"WARC/1.") else None
        got = parsed(whole[0], at) if whole else None
        if got:
            yield got
        at = whole[1] if got else at + 1


def cached(f):
    """read(at, n) over a file, keeping the last stretch read: members are far smaller than a read."""
    kept = [0, b""]

    def read(at: int, n: int) -> bytes:
        a, data = kept
        if not (a <= at and at + n <= a + len(data)):
            f.seek(at)
            kept[:] = [at, f.read(max(n, READ))]
            a, data = kept
        return data[at - a : at - a + n]

    return read


def ranges(archives: DataFrame, split: int = 64 << 20) -> DataFrame:
    """archives(path, bytes) -> a row a byte range."""
    return archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start")).select(
        "path", "start", F.least(F.col("start") + split, F.col("bytes")).alias("stop"))


def read(spark: SparkSession, archives: DataFrame, split: int | None = None) -> DataFrame:
    """archives(path, bytes) -> path, at, record_type, page_id, url, payload, payload_bytes, declared_digest, refers_to; revisits have a null payload. Ranges of `split` bytes; by
    default 64 MB, or less where that would leave cores without work."""
    if split is None:
        total = archives.agg(F.sum("bytes")).first()[0] or 0
        split = max(1 << 20, min(64 << 20, total // (4 * spark.sparkContext.defaultParallelism)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = opened(row["path"])
                with fs.open_input_file(path) as f:
                    rows, held = [], 0
                    for r in scan(cached(f), row["start"], row["stop"]):
                        rows.append(as_row(row["path"], r))
                        held += len(r.body)
                        if held > 16 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    parts = ranges(archives, split)
    n = max(1, min(parts.count(), 100_000))  # ranges, not records: a row for each 64 MB
    return parts.repartition(n).mapInArrow(run, ROWS)


ROWS = "path string, at bigint, record_type string, page_id bigint, url string, payload binary, payload_bytes bigint, declared_digest string, refers_to bigint"


def as_row(path: str, r: Record) -> dict:
    ident = lambda k: (m := re.fullmatch(r"<urn:page:(-?\d+)>", r.headers.get(k, ""))) and int(m[1])
    kind = r.headers.get("warc-type", "")
    return {"path": path, "at": r.at, "record_type": kind, "page_id": ident("warc-record-id"), "url": r.headers.get("warc-target-uri"), "payload": None if kind == "revisit" else r.body,
            "payload_bytes": int(r.headers.get("x-payload-length") or len(r.body)), "declared_digest": r.headers.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": ident("warc-refers-to")}


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "at": pa.int64(), "record_type": pa.string(), "page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "declared_digest": pa.string(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


ORACLE = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first IS NOT NULL AND f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 1000
"""


def op7_warc(spark, sf_dir):
    """Responses' digests are computed anew from the payload read back; a revisit's are those of its record."""
    scratch = Scratch(spark, "warc")
    archives = scratch.cut(write(read_table(spark, sf_dir, "pages"), scratch.path("archives")), "list")
    got = read(spark, archives)
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("declared_digest"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return got.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
