"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader inflates an archive block by block, one member a record, frames the record by its content length and
verifies block and payload digests. Archives are rows of a table (archive, bytes): Spark's own committer stores them
in whatever store the session uses. ``read_files`` takes .warc.gz files in any such store too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Compressed bytes after which the writer begins another archive.
ARCHIVE_BYTES = 8 << 20
#: Compressed bytes that the reader inflates at a time.
READ_BYTES = 1 << 16
GZIP = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "archive string, position long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(rid: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", rid or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response record with the payload, or a revisit record with its headers only if refers_to is given."""
    uri = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:unknown"
    digest = sha1_base32(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Date", DATE)]
    head += [("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return pack.compress(raw.encode() + block + b"\r\n\r\n") + pack.flush()


def members(data: bytes | memoryview) -> Iterator[tuple[int, bytes | None]]:
    """(start, content) of each gzip member, inflated READ_BYTES at a time.

    Content is None for a gap: bytes that can't be inflated, up to the next member that can. A gap is reported once.
    """
    data, at, gap = memoryview(data), 0, None
    while at < len(data):
        inflate, out, start = zlib.decompressobj(31), [], at
        try:
            while not inflate.eof:
                if at >= len(data):
                    raise zlib.error("truncated")
                out.append(inflate.decompress(data[at : at + READ_BYTES]))
                at += READ_BYTES
        except zlib.error:
            gap = start if gap is None else gap
            at = _next_magic(data, start + 1)
            continue
        if gap is not None:
            yield gap, None
            gap = None
        at = min(at, len(data)) - len(inflate.unused_data)
        yield start, b"".join(out)
    if gap is not None:
        yield gap, None


def _next_magic(data: memoryview, at: int) -> int:
    """Where the next gzip header may begin."""
    while at < len(data):
        part = bytes(data[at : at + READ_BYTES])
        found = part.find(GZIP)
        if found >= 0:
            return at + found
        at += max(1, len(part) - len(GZIP) + 1)
    return len(data)


def parse(content: bytes | None) -> dict:
    """The record of a member; ``error`` names the first thing that doesn't hold."""
    none = dict.fromkeys(("record_type", "record_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload"))
    if content is None:
        return none | {"error": "gzip"}
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        return none | {"error": "header"}
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        fields.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        return none | {"error": "content-length"}
    block, kind = rest[:-4], fields.get("warc-type")
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{sha1_base32(block)}":
        return none | {"error": "block digest"}
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(stated[1]) if stated else len(payload)
        if kind == "response" and size != len(payload):
            return none | {"error": "http content-length"}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit":
        got = sha1_base32(payload)
        if digest and digest != got:
            return none | {"error": "payload digest"}
        digest = got
    return {"record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest or None, "payload": None if kind == "revisit" else payload, "error": None}


def with_revisits(pages: DataFrame, id_col: str, text_col: str, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): rows with equal payloads of least_bytes or more refer to the one with the largest id.

    Only digests of payloads are grouped; groups of one aren't joined to.
    """
    payload = C.text_of(text_col).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col("`url`").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("_vl_sha"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("_vl_sha").agg(F.max("page_id").alias("_vl_top"), F.count(F.lit(1)).alias("_vl_n"))
    groups = C.materialize(groups.where("_vl_n > 1"), "warc-groups")
    out = C.attach(rows, groups, ["_vl_sha"], "_vl_n", F.col("page_id").cast("string"))
    return out.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("_vl_top")), F.col("_vl_top")).alias("refers_to"))


def write_archives(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, bytes): WARC archives of all rows of ``pages``.

    A null payload is an empty one, a null or empty url is urn:unknown. A null page id is written as such; rows that
    repeat the largest id of a group with equal payloads are responses all. Other columns of ``pages`` are ignored.
    """
    C.bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        held = 0

        def flush():
            blob = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(blob).hexdigest()[:32] + ".warc.gz"]), pa.array([blob], pa.binary())], ["archive", "bytes"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                parts.append(record(*(x.as_py() for x in row)))
                held += len(parts[-1])
                if held >= archive_bytes:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    return with_revisits(pages, id_col, text_col, least_bytes).mapInArrow(run, "archive string, bytes binary")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of (archive, bytes) rows, in sequence; ``error`` is null for records that verify. payloads: carry them.

    Bytes that aren't a gzip member give one row with the error "gzip", and reading goes on at the next member. Null or
    empty bytes have no records, an archive's name may be null, repeated archives are read each, and other columns are
    ignored. An empty table gives an empty result.
    """
    C.bounded_batches(archives.sparkSession)
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            for name, blob in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for start, content in members(blob.as_buffer() if blob.is_valid else b""):
                    got = parse(content)
                    if not payloads:
                        got["payload"] = None
                    rows.append(got | {"archive": name.as_py(), "position": start})
                    held += len(got["payload"] or b"") + 500
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select("archive", "bytes").mapInArrow(run, RECORD_SCHEMA)


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of .warc.gz files of up to 2 GB each, by any path that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return read_archives(files.select(F.col("path").alias("archive"), F.col("content").alias("bytes")), payloads)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    stored = C.materialize(write_archives(pages), "warc-archives")
    got = read_archives(stored, payloads=False)
    page = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1), F.lit("")).cast("long")
    return got.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "error")


SQL = {
    "op7_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), q AS (
  SELECT *, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS top FROM p
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM q"""
}
