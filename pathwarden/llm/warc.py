"""WARC archives: a writer and a sequential reader.

Writer: one gzip member per record.  A payload seen under a smaller page id
is stored as a ``revisit`` that names the earlier record and keeps the HTTP head
alone.  Archives are rows of a table in the shared folder, ``ARCHIVE_BYTES`` of
compressed records each (a larger record has an archive of its own), so that any
executor can read them again after another one is lost.

Reader: goes through the members one after another, decompressing in
pieces of ``PIECE`` bytes; heads are parsed, the block is framed by Content-Length,
and the SHA-1 of the payload is taken as it passes and held against the record's.  Any kind of record can come: a
block that isn't HTTP (warcinfo, metadata, resource) is its own payload, and a record without a SHA-1 is unverified (null).
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwarden.llm.common import stored

ARCHIVE_BYTES = 4 << 20
PIECE = 1 << 16
#: Records are undated input; all carry the same date, so reruns agree.
DATE = "2000-01-01T00:00:00Z"
_ARCHIVES = "archive binary"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean, payload binary, record_id string"
#: No head is longer.
MOST_HEAD = 1 << 20


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One gzip member; ``refers_to`` makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = urllib.parse.quote(url or "about:blank", safe="%:/?#[]@!$&'()*+,;=~-._")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _members(archive: bytes) -> Iterator[Iterator[bytes]]:
    """The pieces of each gzip member in turn; a caller must use a member up."""
    at = 0
    while at < len(archive):
        z = zlib.decompressobj(31)
        end = [at]

        def pieces(z=z, end=end):
            pending = b""
            while not z.eof:
                if not pending:
                    pending = archive[end[0] : end[0] + PIECE]
                    if not pending:
                        raise ValueError("a member breaks off")
                    end[0] += len(pending)
                out = z.decompress(pending, PIECE)
                pending = z.unconsumed_tail
                if out:
                    yield out
            end[0] -= len(z.unused_data)

        yield pieces()
        at = end[0]


def _head(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _urn(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


class _Block:
    """The rest of a member, to be read in order."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, b""

    def head(self) -> bytes:
        """What comes before the next empty line, which is passed."""
        while b"\r\n\r\n" not in self.rest:
            if len(self.rest) > MOST_HEAD:
                _broken("no end of a head")
            self.rest += next(self.pieces, b"") or _broken("no end of a head")
        out, _, self.rest = self.rest.partition(b"\r\n\r\n")
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            self.rest = self.rest or next(self.pieces, b"") or _broken("the block is short")
            part, self.rest = self.rest[:n], self.rest[n:]
            n -= len(part)
            yield part

    def ends(self) -> bool:
        return self.rest + b"".join(self.pieces) == b"\r\n\r\n"


def _length(head: dict[str, str]) -> int | None:
    value = head.get("content-length", "")
    return int(value) if value.isdigit() else None


def _same(sha: bytes, declared: str | None) -> bool | None:
    """Whether a SHA-1 is the declared one (base32 or hexadecimal); None if none is declared."""
    kind, _, value = (declared or "").partition(":")
    if kind.lower() != "sha1" or not value:
        return None
    return value.upper() == base64.b32encode(sha).decode() if len(value) == 32 else value.lower() == sha.hex()


def read_archive(archive: bytes, keep_payload: bool = True) -> Iterator[dict]:
    """The records in their order; a damaged record ends the archive with ValueError.

    payload_bytes is the length that the HTTP head gives, or of what is there.
    """
    for member in _members(archive):
        record = _Block(member)
        head = _head(record.head())
        size = _length(head)
        if not head[""].startswith("WARC/") or size is None:
            _broken("not a record")
        kind, before, full = head.get("warc-type"), b"", None
        parts = record.take(size)
        if head.get("content-type", "").lower().startswith("application/http"):
            http = _Block(parts)
            if size:
                full = _length(_head(http.head()))
            before, parts = http.rest, http.pieces
        sha, there, kept = hashlib.sha1(before), len(before), [before]
        for part in parts:
            sha.update(part)
            there += len(part)
            if keep_payload:
                kept.append(part)
        if not record.ends():
            _broken("no end of the record")
        revisit = kind == "revisit"
        full = there if full is None or kind == "request" else full
        declared = head.get("warc-payload-digest")
        same = _same(sha.digest(), declared)
        yield {
            "page_id": _urn(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "payload_bytes": full, "payload_digest": (declared or "").partition(":")[2] or None,
            "record_type": kind, "refers_to": _urn(head.get("warc-refers-to")) if revisit else None,
            "verified": there == 0 if revisit else same and there == full, "payload": None if revisit or not keep_payload else b"".join(kept), "record_id": head.get("warc-record-id"),
        }


def _broken(what: str) -> bytes:
    raise ValueError(f"damaged WARC: {what}")


def write_archives(pages: DataFrame, label: str = "warc") -> tuple[DataFrame, str]:
    """Write a record per row of ``pages`` (page_id, url, html); the archives and their path.

    A null html is an empty payload.  Of equal payloads the smallest page id is
    the response (null ids count as largest and are never responses unless all
    are null); repeated rows of that id are responses too.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    slim = slim.withColumn("_sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    firsts = slim.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    marked = slim.join(firsts, "_sha", "left").select(
        "page_id", "url", "html", F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buf, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, ref = (c[i].as_py() for c in b.columns)
                buf.append(make_record(page_id, url, html.encode(), ref))
                size += len(buf[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(buf)], pa.binary())], ["archive"])
                    buf, size = [], 0
        if buf:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(buf)], pa.binary())], ["archive"])

    return stored(marked.mapInArrow(pack, _ARCHIVES), label)


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """A row per record of a table of archives (column ``archive``)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified", "payload", "record_id"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]
        for b in batches:
            for a in b.column(0):
                rows, size = [], 0
                for r in read_archive(a.as_py(), keep_payload):
                    rows.append(r)
                    size += r["payload_bytes"] if keep_payload else 0
                    if size > ARCHIVE_BYTES or len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds)], names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds)], names)

    return archives.select("archive").mapInArrow(unpack, _RECORDS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``.warc.gz`` files; a file is one value of its task, so it can't have more than 2 GB."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive")))


def op9_warc(pages: DataFrame) -> DataFrame:
    """Write, read back, and fail on a record whose digest doesn't hold."""
    archives, _ = write_archives(pages)
    back = read_archives(archives, keep_payload=False)
    sure = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload digest doesn't hold")).cast("string"))
    return back.select("page_id", "payload_bytes", sure.alias("payload_digest"), "record_type", "refers_to")
