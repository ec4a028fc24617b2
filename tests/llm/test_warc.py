import base64
import gzip
import hashlib
import io
import zlib

import pytest

from panelloom.llm import warc as W
from panelloom.operators.store import new_path

PAGES = [(5, "http://a", "same é"), (3, "http://b", "same é"), (9, None, "same é"), (1, "http://c d\n", None), (2, "http://e", ""), (7, "u", "x" * 200_000),
         (None, "n", "same é"), (None, "n", "only null"), (4, "u", "a\r\n\r\nWARC/1.1\r\n"), (3, "again", "same é")]
SCHEMA = "page_id long, url string, html string"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def written(spark, rows, tmp=None, **options):
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS digest", "'x' AS salt")
    return W.write_archives(pages, new_path(spark, "warc-test"), **options)


def test_round_trip(spark):
    got = W.read_archives(written(spark, PAGES), keep_payload=True).collect()
    want = []
    for i, _, t in PAGES:
        ids = [j for j, _, u in PAGES if (u or "") == (t or "") and j is not None]
        first = min(ids, default=None)
        kind = "revisit" if first is not None and len([1 for _, _, u in PAGES if (u or "") == (t or "")]) > 1 and i != first else "response"
        want.append((i, kind, first if kind == "revisit" else None, len((t or "").encode()), b32(t), b"" if kind == "revisit" else (t or "").encode()))
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)


def test_small_payloads_are_responses_and_archives_roll(spark):
    rows = [(k, "u", "dup") for k in range(20)]
    manifest = written(spark, rows, revisit_from=10, roll_bytes=500)
    assert {r.record_type for r in W.read_archives(manifest).collect()} == {"response"}
    assert manifest.count() > 2


def test_one_gzip_member_per_record_that_other_readers_read(spark):
    from pyarrow.fs import FileSystem

    for r in written(spark, PAGES).collect():
        fs, path = FileSystem.from_uri(r.path)
        data = fs.open_input_stream(path, compression=None).read()
        assert gzip.decompress(data).count(b"WARC-Type: ") == r.records + 1
        members, rest = 0, data
        while rest:
            z = zlib.decompressobj(31)
            z.decompress(rest)
            rest, members = z.unused_data, members + 1
        assert members == r.records + 1


def archive():
    return W.page_record(1, "u", b"payload one", False, None) + W.page_record(2, "u", b"payload one", True, 1)


def test_reader_takes_any_chunking_and_long_records():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7))

    data = archive() + W.page_record(3, None, b"z" * 1_000_000, False, None)
    assert [(r.kind, r.payload_bytes) for r in W.Reader(Slow(data))] == [("response", 11), ("revisit", 0), ("response", 1_000_000)]


def test_damage_is_found():
    data = archive()
    for bad in (data[:-5], data[:40] + b"?" + data[41:], gzip.compress(gzip.decompress(data).replace(b"payload one", b"payload two"))):
        with pytest.raises(W.CorruptArchive):
            list(W.Reader(io.BytesIO(bad)))


def test_empty_table(spark):
    manifest = written(spark, [])
    assert manifest.count() == 0 and W.read_archives(manifest).collect() == []
