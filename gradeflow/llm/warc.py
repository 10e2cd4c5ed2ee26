"""Operator 6, WARC: archives with one gzip member per record, and a
sequential reader for them.

Writing.  The payload digest of each page decides which page of a set with
equal payloads is stored (the largest id) and which are revisits of it.  Each
task writes one archive into a shared folder under a name of its own attempt;
the checkpointed manifest names the archives of the attempts that succeeded,
so a file that a lost executor left behind is never read.

Reading.  An archive is read once, front to back: zlib inflates one member
after another from a bounded buffer, the record's Content-Length frames its
block, and SHA-1 digests of block and payload are checked against the headers
while the bytes pass.  A broken archive raises an error with the offset.

Cases.  A null page is an empty payload; a null url has no target header.
Pages that share both id and payload are the same capture and all carry the
type of that id.  A null id is written as ``null`` and is a response only if
all ids with its payload are null.  Other columns are not read.  An empty table
gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm.blocks import partitions
from gradeflow.session import ensure_checkpoint_dir

CHUNK = 1 << 16
MANIFEST = "path string, records long, bytes long"
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "digests_match boolean, payload binary")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def open_store(path: str):
    """File system and path of a location that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", path))


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record as a gzip member.  A revisit keeps the HTTP header, with
    the length of the full payload, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=-._~')}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(page_id, url, html, digest, refers_to): ``refers_to`` is null for responses."""
    thin = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    thin = thin.withColumn("digest", F.sha1("html"))
    stored = thin.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("stored"))
    found = thin.join(stored, "digest", "left")
    return found.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("stored")), F.col("stored")))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write one archive per task under ``folder``; returns the manifest."""
    plan = plan_records(pages, id_col, url_col, html_col, min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, n, size = None, 0, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in cols)
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = record("null" if page_id is None else page_id, url, html.encode("utf-8", "surrogatepass"),
                                base32(bytes.fromhex(digest)), refers_to, refers_to is not None, date)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "bytes": size}])

    return plan.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, MANIFEST).checkpoint()


class Reader:
    """Records of one archive in order, from a stream with ``read(n)``."""

    def __init__(self, stream, name: str = "", chunk: int = CHUNK):
        self.stream, self.name, self.chunk = stream, name, chunk
        self.rest, self.at = b"", 0

    def _fail(self, why: str):
        raise ValueError(f"{self.name}: {why} in the member at byte {self.at}")

    def _member(self) -> Iterator[bytes]:
        inflate = zlib.decompressobj(31)
        used = 0
        while not inflate.eof:
            raw = self.rest or self.stream.read(self.chunk)
            self.rest = b""
            if not raw:
                self._fail("the archive ends")
            try:
                part = inflate.decompress(raw, self.chunk)
                tail = inflate.unconsumed_tail
                used += len(raw) - len(tail) - len(inflate.unused_data)
                yield part
                while tail and not inflate.eof:
                    part = inflate.decompress(tail, self.chunk)
                    used += len(tail) - len(inflate.unconsumed_tail) - len(inflate.unused_data)
                    tail = inflate.unconsumed_tail
                    yield part
            except zlib.error as e:
                self._fail(f"bad gzip data ({e})")
        self.rest = inflate.unused_data
        self.next_at = self.at + used

    def records(self, with_payload: bool = False) -> Iterator[dict]:
        while True:
            if not self.rest:
                self.rest = self.stream.read(self.chunk)
            if not self.rest:
                return
            yield self._record(self._member(), with_payload)
            self.at = self.next_at

    def _record(self, parts: Iterator[bytes], with_payload: bool) -> dict:
        held = b""
        while b"\r\n\r\n" not in held:
            more = next(parts, None)
            if more is None:
                self._fail("no end of the header")
            held += more
        head, held = held.split(b"\r\n\r\n", 1)
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            self._fail("no WARC header")
        field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(field["content-length"])
        block, payload, http, kept, length = hashlib.sha1(), hashlib.sha1(), b"", [], 0
        in_payload = False
        while left:
            if not held:
                held = next(parts, None)
                if held is None:
                    self._fail("the block is shorter than its Content-Length")
                continue
            piece, held = held[:left], held[left:]
            left -= len(piece)
            block.update(piece)
            if not in_payload:
                http += piece
                if b"\r\n\r\n" not in http:
                    continue
                http, piece = http.split(b"\r\n\r\n", 1)
                in_payload = True
            payload.update(piece)
            length += len(piece)
            if with_payload:
                kept.append(piece)
        end = held + b"".join(parts)
        if end != b"\r\n\r\n":
            self._fail("the block is longer than its Content-Length")
        told = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8").split("\r\n")[1:])}
        kind = field["warc-type"]
        bare = lambda name: field[name].removeprefix("sha1:")
        match = bare("warc-block-digest") == base32(block.digest())
        if kind == "response":
            match &= bare("warc-payload-digest") == base32(payload.digest()) and length == int(told["content-length"])
        number = lambda v: None if v in (None, "null") else int(v)
        urn = lambda v: v and re.fullmatch(r"<urn:page:(.*)>", v)[1]
        url = field.get("warc-target-uri")
        return {
            "page_id": number(urn(field["warc-record-id"])), "url": None if url is None else unquote(url),
            "payload_bytes": int(told["content-length"]), "payload_digest": bare("warc-payload-digest"), "record_type": kind,
            "refers_to": number(urn(field.get("warc-refers-to"))), "digests_match": match,
            "payload": b"".join(kept) if with_payload and kind == "response" else None,
        }


def read_archives(manifest: DataFrame, with_payload: bool = False, rows: int = 256) -> DataFrame:
    """All records of the archives that ``manifest`` names, in tasks of whole archives."""
    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, base = open_store(path)
                held = []
                with store.open_input_stream(base, compression=None) as stream:
                    for x in Reader(stream, path).records(with_payload):
                        held.append(x)
                        if len(held) == rows:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return manifest.select("path").repartition(partitions(manifest), "path").mapInArrow(read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, min_bytes=min_bytes))


SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), r AS (
  SELECT hex, max(page_id) AS stored FROM p GROUP BY hex
), n AS (
  SELECT p.*, stored, list_transform(range(0, 8), lambda g: ('0x' || substr(p.hex, 1 + 5 * g, 5))::BIGINT) AS parts FROM p JOIN r USING (hex)
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> s) & 31)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM stored THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM stored THEN stored END AS refers_to,
  true AS digests_match
FROM n
"""
