"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

An archive here is a run of whole members of up to ARCHIVE bytes. Archives are kept as the rows of
a table in the shared folder, so they are committed with their task, work on any store, and a lost
executor costs a retry only; export() writes them as .warc.gz files and read_files() reads such
files by Spark's binaryFile source.

The payload is compressed before the one shuffle, so html travels as gzip members. Which page of
an equal-payload group is the response is an aggregate by (digest), partial sums first; the answer
comes back by joins on page rows without html, where Spark splits skewed keys.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, stored, table

#: Bytes of members in one archive row.
ARCHIVE = 8 * 1024 * 1024
#: Payloads shorter than this are always responses.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"
#: Bytes that are decompressed at once, and of a record's headers at most.
STEP, HEADERS = 1 << 16, 1 << 20


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False, size: int | None = None) -> bytes:
    """One record as one gzip member. A revisit has no block; its headers tell the payload's size."""
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {re.sub('[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), url)}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest() if revisit else digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Payload-Length: {len(payload) if size is None else size}"] if revisit else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Broken(ValueError):
    """An archive whose framing, compression or digests don't hold."""


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes | None]:
    """The decompressed bytes of a gzip stream that comes in chunks, STEP bytes at most at a time, and
    None at the end of each member."""
    unpacker = None
    for chunk in chunks:
        while chunk:
            unpacker = unpacker or zlib.decompressobj(31)
            try:
                piece = unpacker.decompress(chunk, STEP)
            except zlib.error as e:
                raise Broken(f"gzip: {e}") from e
            if piece:
                yield piece
            chunk = unpacker.unconsumed_tail
            if unpacker.eof:
                chunk = unpacker.unused_data
                yield None
                unpacker = None
    if unpacker:
        raise Broken("the archive ends inside a member")


def headers_of(head: bytes) -> dict[str, str]:
    """A record's headers, names in lower case."""
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise Broken("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not headers.get("content-length", "").isdigit():
        raise Broken("no content-length")
    return headers


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, framed by content-length as bytes come:
    a record is held only up to the length that it declares, its headers up to HEADERS bytes."""
    held, headers, start = bytearray(), None, 0
    for piece in inflated(chunks):
        if piece is not None:
            held += piece
            if headers is None and (end := held.find(b"\r\n\r\n")) >= 0:
                headers, start = headers_of(bytes(held[:end])), end + 4
            if headers is None and len(held) > HEADERS:
                raise Broken("no WARC header")
            if headers is None or len(held) <= start + int(headers["content-length"]) + 4:
                continue
        size = -1 if headers is None else int(headers["content-length"])
        if size < 0:
            raise Broken("no WARC header")
        if len(held) != start + size + 4 or held[start + size :] != b"\r\n\r\n":
            raise Broken("content-length does not frame the record")
        yield headers, bytes(held[start : start + size])
        held, headers, start = bytearray(), None, 0


def parse(chunks: Iterable[bytes]) -> Iterator[tuple]:
    """A RECORD row of each record; digests are computed again from what was read."""
    for headers, block in records(chunks):
        digest, kind = hashlib.sha256(block).hexdigest(), headers.get("warc-type")
        said = headers.get("warc-payload-digest", "").removeprefix("sha256:")
        if headers.get("warc-block-digest", f"sha256:{digest}") != f"sha256:{digest}" or kind == "response" and said not in ("", digest):
            raise Broken(f"digest of {headers.get('warc-record-id')}")
        revisit = kind == "revisit"
        size = int(headers["x-payload-length"]) if revisit and "x-payload-length" in headers else len(block)
        yield _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), size, said if revisit else digest, kind, _page(headers.get("warc-refers-to")), True


def _pieces(data: bytes) -> Iterator[bytes]:
    view = memoryview(data)
    return (bytes(view[k : k + STEP]) for k in range(0, len(view), STEP))


def _rows(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"])


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives (archive binary) of the table's page_id, url and html, in the shared folder.

    A null html is an empty payload; a null url gives no target URI; a null page_id gives a record
    id without number. Of equal payloads of at least 100 bytes the smallest page_id is the response
    (all rows that repeat it are) and the others revisit it; if all their ids are null, all are
    responses. Other columns are not read.
    """
    prepare(pages.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((page_id, url, len(payload), bytes.fromhex(digest), member(page_id, url, payload, digest)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["page_id", "url", "size", "digest", "member"])

    packed = stored(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(pack, "page_id long, url string, size long, digest binary, member binary"), "warc-members")
    firsts = packed.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("__n"))
    firsts = firsts.where("__n > 1 and first is not null").select("digest", "first")
    again = packed.select("page_id", "digest", "size").where(F.col("size") >= LEAST).join(firsts, "digest")
    again = again.where("page_id is null or page_id <> first").select("page_id", "digest", "first").distinct()
    joined = _with_first(packed, again)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, length, digest, first, data in zip(*(c.to_pylist() for c in batch.columns)):
                if first is not None:
                    data = member(page_id, url, b"", digest.hex(), first, True, length)
                held.append(data)
                size += len(data)
                if size >= ARCHIVE:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    return stored(joined.mapInArrow(bundle, "archive binary"), "warc-archives")


def _with_first(packed: DataFrame, again: DataFrame) -> DataFrame:
    """packed with `first`, the response that a revisit refers to, else null."""
    keys = again.select(F.col("page_id").alias("__p"), F.col("digest").alias("__d"), "first")
    match = F.col("page_id").eqNullSafe(F.col("__p")) & (F.col("digest") == F.col("__d"))
    joined = packed.join(keys, match, "left")
    return joined.select("page_id", "url", "size", "digest", "first", F.when(F.col("first").isNull(), F.col("member")).alias("member"))


def read_archives(archives: DataFrame) -> DataFrame:
    """RECORD rows of archives. A record that breaks its framing or digests fails the job."""
    prepare(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                yield _rows(parse(_pieces(archive.as_py())))

    return archives.select("archive").mapInArrow(read, RECORD)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Write archives as .warc.gz files from the driver, one archive at a time."""
    out = []
    for k, row in enumerate(archives.toLocalIterator()):
        path = Path(folder, f"part-{k:05d}.warc.gz")
        path.write_bytes(row.archive)
        out.append(str(path))
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first is null or first = page_id then null else first end as refers_to
from p left join f using (payload_digest)"""
