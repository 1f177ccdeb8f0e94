"""WARC archives: one gzip member for each record, written and read sequentially by Spark tasks.

Writing: each task writes its rows to archives of a bounded size in the shared folder, under a temporary name
that becomes the final one when the archive is complete, so a task that is lost or repeated leaves no
half archive under a name that is read. Reading: each archive is one unit of work; it is inflated
piece by piece, a record's header and content length say where its block ends, the block
is hashed as it passes, and a member that doesn't end with its record or a digest that doesn't match is an error.

Of records with equal payloads the one with the largest id is the response and the others are revisits that name it.

Defined cases: a null payload counts as empty; a null id is written as a record without one and refers to
nothing that could be named; rows of the same id and payload are all the response; a group whose ids are all null is
all response; a null target URI is written as an empty one; a URI or content with any characters, CR and LF included, is
kept (the URI percent-encoded where it must be); payloads of any length are passed in pieces when hashed and
inflated; an empty table writes no archive; other columns are never looked at.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, in_arrow, looked_up, scratch, small_side

#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 16
#: Tasks that read archives at most; beyond it a task reads several, one after another.
MOST_TASKS = 100_000
#: Records of an output batch at most, and bytes of payload in it when payloads are asked for.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMED = "urn:record:"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def _member(header: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in header) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    header = [("WARC-Type", kind), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "", safe="/:?#[]@!$&'()*+,;=~%-._")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        header.append(("WARC-Record-ID", f"<{NAMED}{page_id}>"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        header += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{NAMED}{refers_to}>")]
        payload = b""  # a revisit keeps the HTTP header only, with the full payload's length
    header += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", "sha1:" + _base32(hashlib.sha1(http + payload)))]
    return _member(header, http + payload)


def _base32(h) -> str:  # noqa: ANN001
    return base64.b32encode(h.digest()).decode()


def with_references(pages: DataFrame, id_col: str, payload_col: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """(id, url?, payload, refers_to): refers_to is the largest id among equal payloads, null on the response itself.

    Payloads meet as digests; only where a payload repeats is a row looked up. If the table of repeated digests is too large to broadcast, ids
    and digests find out which rows revisit another, and only rows that a filter of those can't rule out move, each by its own id and digest.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    own = pages.withColumn("_d", F.sha1(payload))
    seen = own.groupBy("_d").agg(F.max(id_col).alias("top"), F.count("*").alias("n"))
    seen = cut(seen.where("n > 1").select(F.col("_d").alias("d"), "top"))
    again = F.when(F.col("top") != F.coalesce(F.col(id_col), F.col("top") - 1), F.col("top"))
    if (n := seen.count()) <= most:
        return own.join(small_side(seen, n), F.col("_d") == F.col("d"), "left").withColumn("_refers", again)
    own = own.withColumn("_k", F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("none")), "_d"))
    found = own.select(id_col, "_d", "_k").join(seen, F.col("_d") == F.col("d")).select("_k", again.alias("_refers"))
    return looked_up(own, cut(found.where("_refers is not null").distinct()), ["_k"], most)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each row and returns the archives: (archive, records, bytes)."""
    plain = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), F.col(payload_col).alias("p"))
    rows = with_references(plain, "i", "p").select("i", "u", F.coalesce("p", F.lit("")).cast("binary").alias("p"), F.col("_refers").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        part, attempt, done = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), []
        out, name, size, count = None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                # Each attempt has names of its own: a late or repeated one can't overwrite what another has reported.
                final = f"{at}/part-{part:05d}-{attempt}-{len(done):04d}.warc.gz"
                fs.move(name, final)
                done.append((f"{folder}/{os.path.basename(final)}", count, size))
                out = None

        for batch in batches:
            for i, u, p, r in zip(*(batch.column(k) for k in range(4)), strict=True):
                data = p.as_py()
                member = _record(i.as_py(), u.as_py(), data, _base32(hashlib.sha1(data)), r.as_py())
                if out is None:
                    fs.create_dir(at, recursive=True)
                    name, size, count = f"{at}/open-{uuid.uuid4().hex}", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"archive": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64()), "bytes": pa.array([d[2] for d in done], pa.int64())})

    return cut(in_arrow(rows, run, "archive string, records bigint, bytes bigint"))


class _Stream:
    """The inflated bytes of one gzip member after another."""

    def __init__(self, raw):  # noqa: ANN001
        self.raw, self.rest, self.z, self.held = raw, b"", None, bytearray()

    def next_member(self) -> bool:
        """False at the end of the archive."""
        if not self.rest:
            self.rest = self.raw.read(READ_BYTES)
        if not self.rest:
            return False
        self.z = zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.rest or self.raw.read(READ_BYTES)
        self.rest = b""
        if not data:
            raise ValueError("the archive ends within a record")
        self.held += self.z.decompress(data, READ_BYTES)
        if self.z.eof:
            self.rest = self.z.unused_data
        return True

    def line(self) -> bytes:
        while (end := self.held.find(b"\r\n")) < 0:
            if not self._more():
                raise ValueError("a record's header isn't complete")
        out = bytes(self.held[:end])
        del self.held[: end + 2]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.held and not self._more():
                raise ValueError("a record is shorter than its content length")
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            yield piece

    def end(self) -> None:
        if b"".join(self.take(4)) != b"\r\n\r\n":
            raise ValueError("a record is longer than its content length")
        while self._more():
            pass
        if self.held:
            raise ValueError("a gzip member holds more than one record")


def records(raw, keep: Callable[[bytes], None] | None = None) -> Iterator[dict]:  # noqa: ANN001
    """The records of an archive (a binary stream), in order, each checked against its digests."""
    s = _Stream(raw)
    while s.next_member():
        if not s.line().startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while line := s.line():
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        block, payload, http, body, http_size = hashlib.sha1(), hashlib.sha1(), b"", 0, None
        for piece in s.take(int(head["content-length"])):
            block.update(piece)
            if http_size is None:
                http += piece
                if (cut_at := http.find(b"\r\n\r\n")) < 0:
                    continue
                piece, http, http_size = http[cut_at + 4 :], http[:cut_at], cut_at
            payload.update(piece)
            body += len(piece)
            if keep:
                keep(piece)
        s.end()
        if head.get("warc-block-digest") != "sha1:" + _base32(block):
            raise ValueError("a block doesn't match its digest")
        declared = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length")
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response" and (declared != body or digest != _base32(payload)):
            raise ValueError("a payload doesn't match its length or digest")
        number = lambda v: int(v.strip("<>").removeprefix(NAMED)) if v else None
        yield {
            "page_id": number(head.get("warc-record-id")), "url": unquote(head.get("warc-target-uri", "")), "payload_bytes": declared,
            "payload_digest": digest, "record_type": head["warc-type"], "refers_to": number(head.get("warc-refers-to")),
        }


SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives (column `archive`), with `payload` (null for revisits) if asked for.

    Each archive is a task of its own, up to MOST_TASKS; a range partitioning by name deals them out evenly, and as its
    number is given it isn't coalesced, however short the names are.
    """
    tasks = max(1, min(MOST_TASKS, archives.count()))  # of a table that was written, one short row for each archive
    names = archives.select("archive").repartitionByRange(tasks, "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        kinds += [("payload", pa.binary())] * payloads
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], names=[k for k, _ in kinds])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = _open(name)
                with fs.open_input_stream(at, compression=None) as raw:
                    held, rows, size = [], [], 0
                    for r in records(raw, held.append if payloads else None):
                        if payloads:
                            r["payload"] = b"".join(held) if r["record_type"] == "response" else None
                            size += len(r["payload"] or b"")
                            held.clear()
                        rows.append(r)
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield pack(rows)
                            rows, size = [], 0
                    if rows:
                        yield pack(rows)

    return in_arrow(names, run, SCHEMA + ", payload binary" * payloads)


def new_folder(spark) -> str:  # noqa: ANN001
    """A folder of its own in the shared scratch folder."""
    return f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
