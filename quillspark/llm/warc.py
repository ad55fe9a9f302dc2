"""WARC archives with boundary-chain verification (operator 6).

Writing: Spark's own text writer puts records into uncompressed archives that are closed after about FILE_MB, so any store that Spark knows will do.
Of equal payloads the page with the smallest id becomes the response record, the others revisit records without a payload. Digests are made in the
JVM. Payloads that occur twice are looked up in a broadcast table while that has at most BROADCAST_ROWS rows; beyond it pages are joined with
their verdicts by page id and digest, so copies of one payload never meet in one task.

Reading: a task per archive looks for the record magic anywhere, also inside payloads, and emits each candidate with the offset its header makes the
successor. Candidates are grouped in segments of the file; within a segment the chain of each candidate is followed at once, so that global
pointer jumping from the start of each file needs log2(segments) joins. Only candidates that the start of their file reaches are records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.column import Column

from .common import lean, slices, staged, staged_path, thin_batches

MAGIC, CRLF = b"WARC/1.1\r\n", "\r\n"
FILE_MB, SEGMENT, BROADCAST_ROWS = 16, 4 << 20, 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_text(page_id: int | None, url: str | None, payload: str, digest: str, refers_to: int | None, revisit: bool, size: int) -> str:
    """One record without its closing two line ends. The HTTP header names the full payload's length in revisits too."""
    http = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}", "", ""])
    block = http if revisit else http + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {i}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url or '')}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"Content-Length: {len(block.encode())}", "", ""]
    return CRLF.join(head) + block


def base32_digest(text: Column) -> Column:
    """base32_sha1 of a string column, from its hexadecimal digest: five hexadecimal digits are four of base 32."""
    hexa = F.sha1(text.cast("binary"))
    quads = F.concat(*(F.lpad(F.conv(F.substring(hexa, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)))
    return F.translate(quads, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads compressed for a shuffle."""
    for batch in slices(batches, 4):
        html = pa.array([zlib.compress(h, 6) for h in batch.column(4).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], html], names=["page_id", "url", "size", "digest", "html"])


def _records(packed: bool, file_bytes: int):
    """Rows (page_id, url, size, digest, html, first) as records, joined to runs that make one archive each."""
    end = CRLF * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in slices(batches, 4):
            for page, url, size, digest, html, first in zip(*(batch.column(k).to_pylist() for k in range(6))):
                revisit = first is not None and page is not None and first != page
                payload = "" if revisit else zlib.decompress(html).decode() if packed else html
                out.append(record_text(page, url, payload, digest, first, revisit, size))
                held += 0 if revisit else size
                held += 600
                if held >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([end.join(out)], pa.string())], names=["value"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(out)], pa.string())], names=["value"])

    return run


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS, file_bytes: int = FILE_MB << 20) -> None:
    """pages (page_id long, url string, html string, ...) -> archives in the folder `path`, each closed by the page that fills `file_bytes`.

    Null html is an empty payload. Payloads under `least_bytes` are always responses. Rows with a null page_id are responses; rows that
    repeat a page_id are written each. An empty table writes no record. Other columns are ignored.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = thin_batches(pages).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.octet_length(html).cast("long").alias("size"),
        base32_digest(html).alias("digest"),
        html.alias("html"),
    )
    known = rows.where("page_id is not null").where(F.col("size") >= least_bytes)
    # partial sums first, so a payload that a third of all pages share is one row of each task; its size stays in the key, as in the digest's stead
    twice = known.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    twice = staged(twice.select("digest", "size", "first"), "twice")
    cols = ["page_id", "url", "size", "digest", "html", "first"]
    if few := twice.count() <= broadcast_rows:
        joined = rows.join(F.broadcast(twice), ["digest", "size"], "left")
    else:
        # narrow rows find their first page, then only pages, with payloads packed, meet the copies among them by page
        copies = staged(known.select("page_id", "digest", "size").distinct().join(twice, ["digest", "size"]).where("first <> page_id"), "copies")
        packed = rows.where("page_id is not null").select(*cols[:5]).mapInArrow(lean("warc", _packed), "page_id long, url string, size long, digest string, html binary")
        joined = packed.join(copies, ["page_id", "digest", "size"], "left")
        alone = rows.where("page_id is null").select(*cols[:5], F.lit(None).cast("long").alias("first"))
        _write(alone, path, False, file_bytes, "append")
    _write(joined.select(*cols), path, not few, file_bytes, "append")


def _write(rows: DataFrame, path: str, packed: bool, file_bytes: int, mode: str) -> None:
    text = rows.mapInArrow(lean("warc", _records(packed, file_bytes)), "value string")
    text.write.mode(mode).option("lineSep", CRLF * 2).option("maxRecordsPerFile", 1).text(path)


def candidates_of(content: bytes) -> list[tuple]:
    """(offset, successor, type, page_id, refers_to, declared digest, payload bytes, payload digest) for every magic with a whole header."""
    out, at = [], content.find(MAGIC)
    while at >= 0:
        stop = content.find(b"\r\n\r\n", at)
        head = {}
        if stop >= 0:
            for line in content[at + len(MAGIC) : stop].split(b"\r\n"):
                k, sep, v = line.partition(b":")
                if sep:
                    head[k.strip().lower()] = v.strip()
        length = head.get(b"content-length", b"")
        if stop >= 0 and length.isdigit() and (end := stop + 4 + int(length)) <= len(content) and content[end : end + 4] == b"\r\n\r\n":
            block = content[stop + 4 : end]
            http, _, payload = block.partition(b"\r\n\r\n")
            number = lambda k: int(head[k]) if head.get(k, b"").lstrip(b"-").isdigit() else None
            kind, digest = head.get(b"warc-type", b"").decode("utf-8", "replace"), head.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
            if kind == "revisit":
                size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and x.split(b":")[1].strip().isdigit()), 0)
                own = digest
            else:
                size, own = len(payload), base32_sha1(payload)
            out.append((at, end + 4, kind, number(b"x-page-id"), number(b"x-refers-to-page-id"), digest, size, own))
        at = content.find(MAGIC, at + 1)
    return out


_FOUND = [
    ("path", pa.string()), ("off", pa.int64()), ("next", pa.int64()), ("leave", pa.int64()), ("segment", pa.int64()), ("record_type", pa.string()),
    ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
]


def _scan(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = candidates_of(content.as_buffer().to_pybytes())
                if not rows:
                    continue
                off, nxt = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
                # jump within the segment until the chain leaves it or breaks
                at = np.searchsorted(off, nxt)
                known = (at < len(off)) & (off[np.minimum(at, len(off) - 1)] == nxt)
                to = np.where(known & (nxt // segment == off // segment), at, np.arange(len(off)))
                while not np.array_equal(to[to], to):
                    to = to[to]
                _, _, kind, page, refers, _, size, digest = zip(*rows)
                cols = [[path] * len(off), off, nxt, nxt[to], off // segment, kind, page, refers, digest, size]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FOUND)], schema=pa.schema(_FOUND))

    return run


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by path, segment and offset: keep those on the chain from their segment's entry."""
    key, want = None, None
    for batch in batches:
        keep = []
        for p, s, off, nxt, entry in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if (p, s) != key:
                key, want = (p, s), entry
            keep.append(off == want)
            if off == want:
                want = nxt
        yield batch.select(range(5, batch.num_columns)).filter(pa.array(keep, pa.bool_()))


def read_warc(spark: SparkSession, path: str, segment: int = SEGMENT) -> DataFrame:
    """Archives in a folder -> page_id, payload_bytes, payload_digest, record_type, refers_to of the reachable records.

    Magic inside payloads, and all that follows a broken header, is left out. A folder without archives gives an empty result. Empty payloads have
    0 bytes; records whose page id or reference is missing or no number have null there; records that occur twice give two rows. Each archive
    is held whole by one task, as a store that only Spark reads has no ranges; an archive of 2 GB or more can't be read.
    """
    files = thin_batches(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path))
    shape = "path string, off long, next long, leave long, segment long, record_type string, page_id long, refers_to long, payload_digest string, payload_bytes long"
    found = staged(files.select("path", "content").mapInArrow(lean("warc", _scan(segment)), shape), "candidates")
    last = found.agg(F.max("segment")).first()[0] or 0
    reached = found.where("off = 0").select("path", "off")
    if last:
        jump = found.where("leave > off").select("path", "off", "leave")
        reached, hops = staged(reached, "reached"), 1
        while hops <= last:
            ahead = reached.join(jump, ["path", "off"]).select("path", F.col("leave").alias("off"))
            reached = staged(reached.unionByName(ahead).distinct(), "reached")
            hops *= 2
            if hops <= last:
                then = jump.select("path", F.col("off").alias("leave"), F.col("leave").alias("far"))
                jump = staged(jump.join(then, ["path", "leave"], "left").select("path", "off", F.coalesce("far", "leave").alias("leave")), "jump")
    # the first offset reached is a segment's entry; behind it may stand the file's end or a broken chain's last target
    entries = reached.groupBy("path", F.floor(F.col("off") / segment).cast("long").alias("segment")).agg(F.min("off").alias("entry"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    chained = found.join(entries, ["path", "segment"]).select("path", "segment", "off", "next", "entry", *cols)
    chained = chained.repartition("path", "segment").sortWithinPartitions("path", "segment", "off")
    return chained.mapInArrow(_follow, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> what `read_warc` finds in the archives that `write_warc` makes of them: one row for each row, with null
    html as an empty payload, null page ids as responses, and repeated rows each. An empty table gives an empty result; other columns are ignored."""
    spark = pages.sparkSession
    path = staged_path(spark, "archives")
    write_warc(pages, path)
    return read_warc(spark, path)


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as hex, html, min(page_id) over (partition by html) as first from p),
b as (select *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(hex, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31), 1)) as c from d)
select page_id, payload_bytes, array_to_string(c, '') as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to from b
"""
