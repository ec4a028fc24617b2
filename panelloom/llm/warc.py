"""WARC archives: a writer with revisit records and a sequential, verifying reader.

Writing: one gzip member per record, a ``warcinfo`` record first, archives rolled at
``roll_bytes``. Of pages with equal payloads the one with the smallest page_id is a ``response``,
the others are ``revisit`` records that keep the HTTP header and refer to it; payloads shorter
than ``revisit_from`` bytes are always responses. Equal payloads are found by grouping SHA-1
digests (partial aggregation first); the join back is salted, so a payload that a third of all
pages share is spread over tasks. A task writes files of its own, under names no other attempt
uses, and only files of finished tasks enter the manifest, so lost executors leave no trace.

Reading: a file is read in chunks, each member is decompressed incrementally, the block is
framed by Content-Length, and block and payload digests are recomputed while it streams. A
wrong digest, length or member boundary raises. Memory is one chunk, or one record where the
payload is asked for.

Null html is an empty payload, a null url leaves the target URI out. Rows that share page_id and
payload are all responses (or all revisits of a smaller id). A null page_id never is the
smallest unless there is no other; it reads back as null. Empty tables give an empty manifest
and no records. Extra columns are ignored. ``folder`` is any URI that pyarrow's file systems and
all executors reach.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators.store import written

from .common import salted_left_join

CHUNK = 1 << 16
ROLL_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 5
MANIFEST = "path string, records long, bytes long"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(kind: str, block: bytes, headers: dict[str, str]) -> bytes:
    """One WARC record as one gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers.items()),
             f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Record-ID": name(page_id)}
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    headers["WARC-Payload-Digest"] = f"sha1:{_b32(hashlib.sha1(payload).digest())}"
    if revisits:
        headers |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    "Content-Type": "application/http; msgtype=response"}
        return record("revisit", http, headers)
    return record("response", http + payload, headers | {"Content-Type": "application/http; msgtype=response"})


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]


class CorruptArchive(ValueError):
    pass


class Reader:
    """Records of one archive, in order; ``file`` needs ``read(n)``."""

    def __init__(self, file, keep_payload: bool = False):
        self._file, self._keep = file, keep_payload
        self._raw = b""  # compressed bytes not yet taken
        self._z = None
        self._out = b""  # decompressed bytes of this member not yet taken

    def _fill(self) -> bool:
        """Decompress some more of this member; False at its end."""
        while not self._z.eof:
            if self._z.unconsumed_tail:
                data = self._z.unconsumed_tail
            else:
                data = self._raw or self._file.read(CHUNK)
                self._raw = b""
                if not data:
                    raise CorruptArchive("the archive ends inside a member")
            got = self._z.decompress(data, CHUNK)
            if self._z.eof:
                self._raw = self._z.unused_data
            if got:
                self._out += got
                return True
        return False

    def _head(self, what: str) -> bytes:
        while (at := self._out.find(b"\r\n\r\n")) < 0:
            if not self._fill():
                raise CorruptArchive(f"a {what} header does not end")
        head, self._out = self._out[:at], self._out[at + 4 :]
        return head

    @staticmethod
    def _fields(head: bytes) -> dict[str, str]:
        pairs = (line.split(":", 1) for line in head.decode("utf-8").split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, v in pairs}

    def __iter__(self) -> Iterator[Record]:
        while True:
            self._raw = self._raw or self._file.read(CHUNK)
            if not self._raw:
                return
            try:
                yield self._one()
            except zlib.error as e:
                raise CorruptArchive(str(e)) from e

    def _one(self) -> Record:
        self._z, self._out = zlib.decompressobj(31), b""
        head = self._head("record")
        if not head.startswith(b"WARC/"):
            raise CorruptArchive("not a WARC record")
        headers = self._fields(head)
        left = int(headers["content-length"])
        block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
        size, http_head, in_payload = 0, b"", headers["warc-type"] not in ("response", "revisit")
        while left:
            if not self._out and not self._fill():
                raise CorruptArchive("a block is shorter than its length")
            part, self._out = self._out[:left], self._out[left:]
            left -= len(part)
            block.update(part)
            if not in_payload:
                http_head += part
                at = http_head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                part, http_head, in_payload = http_head[at + 4 :], http_head[:at], True
            payload.update(part)
            size += len(part)
            if self._keep:
                kept.append(part)
        while self._fill():
            pass
        if self._out != b"\r\n\r\n":
            raise CorruptArchive("a block does not end at its length")
        if headers.get("warc-block-digest", "").removeprefix("sha1:") != _b32(block.digest()):
            raise CorruptArchive(f"block digest of {headers.get('warc-record-id')}")
        http = self._fields(http_head) if http_head else {}
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if headers["warc-type"] == "response" and (digest != _b32(payload.digest()) or int(http["content-length"]) != size):
            raise CorruptArchive(f"payload digest of {headers.get('warc-record-id')}")
        return Record(headers, http, size, digest, b"".join(kept) if self._keep else None)


def revisit_plan(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, payload, revisits, refers_to of every page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    groups = (
        rows.where(F.length("payload") >= revisit_from).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return salted_left_join(rows, groups, "digest", F.col("page_id")).select(
        "page_id", "url", "payload", revisits.alias("revisits"), F.when(revisits, F.col("first_id")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all pages as archives in ``folder``; returns the manifest (path, records, bytes)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, n, size = None, "", 0, 0
        for b in batches:
            for page_id, url, payload, revisits, refers_to in zip(b["page_id"], b["url"], b["payload"], b["revisits"], b["refers_to"]):
                if out is not None and size >= roll_bytes:
                    out.close()
                    yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})
                    out = None
                if out is None:
                    file = f"{uuid.uuid4().hex}.warc.gz"
                    path, n, size, out = f"{folder}/{file}", 0, 0, fs.open_output_stream(f"{root}/{file}", compression=None)
                    info = record("warcinfo", b"format: WARC File Format 1.1\r\n", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Filename": file, "Content-Type": "application/warc-fields"})
                    size += out.write(info) or len(info)
                whole = lambda x: None if pd.isna(x) else int(x)
                data = page_record(whole(page_id), url, bytes(payload), bool(revisits), whole(refers_to))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})

    return written(revisit_plan(pages, revisit_from).mapInPandas(write, MANIFEST), "warc-manifest")


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Response and revisit records of all archives, verified; the payload only where it is asked for."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        number = re.compile(r"<urn:x-page:(-?\d+)?>")
        page = lambda x: int(m[1]) if x and (m := number.fullmatch(x)) and m[1] else None
        for b in batches:
            for path, expected in zip(b["path"], b["records"]):
                fs, local = FileSystem.from_uri(path)
                rows, n = [], 0
                with fs.open_input_stream(local, compression=None) as f:
                    for r in Reader(f, keep_payload):
                        if r.kind not in ("response", "revisit"):
                            continue
                        n += 1
                        size = r.payload_bytes if r.kind == "response" else int(r.http["content-length"])
                        rows.append((page(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), r.kind, page(r.headers.get("warc-refers-to")), size, r.payload_digest, r.payload))
                        if len(rows) >= (100 if keep_payload else 5_000):
                            yield frame(rows)
                            rows = []
                if n != expected:
                    raise CorruptArchive(f"{path} has {n} of {expected} records")
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORDS.split(", ")])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = max(1, manifest.count())
    return manifest.repartition(min(files, 10_000)).mapInPandas(read, RECORDS)


OP4_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), h AS (
    SELECT page_id, octet_length(b) AS payload_bytes, unhex(sha1(b)) AS d, min(page_id) OVER (PARTITION BY sha1(b)) AS first_id FROM p
), bits AS (
    SELECT *, list_transform(range(32), lambda i: list_reduce(list_transform(range(5), lambda j:
        get_bit(d::BIT, (5 * i + j)::INTEGER) << (4 - j)), lambda a, c: a + c)) AS digits
    FROM h
)
SELECT page_id, payload_bytes,
    list_reduce(list_transform(digits, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (k + 1)::INTEGER, 1)), lambda a, c: a || c) AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits
"""
