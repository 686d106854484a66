"""WARC archives, index first.

Writing: payload digests (SHA-1) and lengths are computed in Spark; of equal
payloads of ``REVISIT_BYTES`` or more, the page of largest id is the response
and the others are revisit records that name it. Tasks write one archive per
``FILE_BYTES`` of records, each record a gzip member, under a name of their
own, and return an index row per record: file, offset, length, URL, digest.
Only the index of tasks that succeeded is kept, so an archive of a lost
attempt is never read.

Reading: index rows are selected first. Within spans of ``SPAN_BYTES`` of a
file, sorted byte ranges closer than ``GAP`` bytes are read as one, and each
record is cut from it, checked against its digest and parsed. Archives lie in
the cluster's shared folder and are opened through its file system URI.

Defined results: a null html is an empty payload; a null URL is written as an
empty target and read as null; rows that repeat a page_id are written each
(equal ones are all responses if theirs is the largest id); a row with a null
id has id null and, when another page has the same long payload, revisits it;
an empty table gives an empty index and result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch, filesystem

REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
SPAN_BYTES = 8 << 20           # bytes of a file that one group reads, about
READ_BYTES, GAP = 4 << 20, 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # the pages table has no crawl time

INDEX = "file string, offset long, length long, url string, payload_digest string, record_type string"
PAGES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary"


def marked(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html, size, digest, refers_to (null: response) per row.

    The shared digests are written before the pages meet them, so that one
    payload of a third of all pages is split by the skew join.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"),
                        F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("digest"))
    latest = rows.where((F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull()) \
        .groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    return rows.join(scratch.save(latest, "shared-payloads"), F.col("digest") == F.col("d"), "left") \
        .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))) \
        .select("page_id", "url", "html", "size", "digest", "refers_to")


def _record(page_id, url, html: bytes, size: int, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else html)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url or ''}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) under ``folder``; lazily gives the index rows.

    Evaluate the result once, into a table: each evaluation writes archives.
    """
    def run(batches):
        system, inner = filesystem(folder)
        system.create_dir(inner, recursive=True)
        out, name, at, rows = None, "", 0, []
        flush = lambda: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))],
            ["file", "offset", "length", "url", "payload_digest", "record_type"])
        for batch in batches:
            for r in zip(*(c for c in batch.columns)):
                page_id, url, html, size, digest, refers_to = (x.as_py() for x in r)
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{inner}/{name}", compression=None)
                data = _gzip(_record(page_id, (url or "").replace("\r", "").replace("\n", ""), html.encode(), size, digest, refers_to))
                out.write(data)
                rows.append((name, at, len(data), url, digest, "response" if refers_to is None else "revisit"))
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if rows:
                yield flush()
                rows = []
        if out is not None:
            out.close()
    return marked(pages, scratch).mapInArrow(run, INDEX)


def ranges(offsets, lengths):
    """(first, last, start, end): runs of sorted records that are read together."""
    first, n = 0, len(offsets)
    for k in range(1, n + 1):
        if k == n or offsets[k] - (offsets[k - 1] + lengths[k - 1]) > GAP or offsets[k] + lengths[k] - offsets[first] > READ_BYTES:
            yield first, k, int(offsets[first]), int(offsets[k - 1] + lengths[k - 1])
            first = k


def parse(data: bytes) -> dict:
    """Fields of one record; ``html`` is null for a revisit."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    body = body[:int(fields["Content-Length"])]
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    revisit = fields["WARC-Type"] == "revisit"
    html = None if revisit else body.partition(b"\r\n\r\n")[2]
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"] or None,
            "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(html), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
            "html": html}


def read(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records that ``index`` selects, parsed; see ``PAGES``."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        system, inner = filesystem(folder)
        f = f.sort_values("offset", ignore_index=True)
        offsets, lengths, out = f.offset.to_numpy(), f.length.to_numpy(), []
        with system.open_input_file(f"{inner}/{f.file.iloc[0]}") as source:
            for first, last, start, end in ranges(offsets, lengths):
                data = source.read_at(end - start, start)
                for k in range(first, last):
                    at = int(offsets[k]) - start
                    record = parse(zlib.decompress(data[at:at + int(lengths[k])], 31))
                    if record["html"] is not None and hashlib.sha1(record["html"]).hexdigest() != f.payload_digest[k]:
                        raise ValueError(f"digest of {f.file[k]} at {offsets[k]} differs from the index")
                    if not payload:
                        record["html"] = None
                    out.append(record)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])
        return frame.astype({"page_id": "Int64", "refers_to": "Int64"})
    return index.withColumn("span", F.floor(F.col("offset") / SPAN_BYTES)).groupBy("file", "span").applyInPandas(run, PAGES)


def round_trip(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes archives and their index, then reads every record back."""
    folder = scratch.folder("archives")
    index = scratch.save(write(pages, folder, scratch), "index")
    return read(index, folder, payload=False)


def oracle() -> str:
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> last THEN last END AS refers_to FROM m"""
