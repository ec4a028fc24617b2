"""Fill-in-the-middle by content-defined chunks.

A rolling hash of the last 16 bytes cuts a text into chunks, so a passage that documents share
falls into the same chunks wherever it stands. Each chunk is summarised once for all tasks of a
Python worker: how many code points begin in it, whether a sentinel lies inside, and its first
and last bytes, which show a sentinel across a border. The cache finds a chunk by its content,
compared byte by byte. Adding the counts of the chunks gives the length of the document and the
chunk in which each cut lies; only that chunk is looked at for the byte of the cut.

The form and the cuts follow from SHA-256 of ``1:`` and the decimal id (a null id: nothing after
the colon). Null texts are empty; empty texts, and texts that contain a sentinel, stay plain.
Repeated rows get equal answers; an empty table gives an empty result; only the two named
columns are read. No shuffle: a task holds one Arrow batch of texts and a cache of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = tuple(s.encode() for s in (PREFIX, SUFFIX, MIDDLE))
REACH = max(map(len, SENTINELS)) - 1  # bytes of a sentinel that can lie on one side of a border
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
CUT_MASK = np.uint32(0x03FF0000)  # ten bits, each of which depends on all 16 bytes of the window or most of them
LEAST, LARGEST = 64, 1 << 16  # bytes of a chunk; the last one of a text may be shorter
CACHED_BYTES = 32 << 20

# A fixed number for each byte value, from a rule.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def chunk_ends(text: bytes) -> list[int]:
    """Ends of the chunks of a text. A cut stands where the rolling hash of the last 16 bytes has ten zero bits."""
    if len(text) <= LEAST:
        return [len(text)] if text else []
    h = GEAR[np.frombuffer(text, np.uint8)]
    for k in (1, 2, 4, 8):  # after each step the hash reaches twice as far back
        h[k:] += h[:-k] << np.uint32(k)
    ends, last = [], 0
    for end in (*(np.flatnonzero((h & CUT_MASK) == 0) + 1).tolist(), len(text)):
        while end - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if end - last >= LEAST or end == len(text) > last:
            ends.append(end)
            last = end
    return ends


class Summary(NamedTuple):
    points: int  # code points that begin in the chunk
    sentinel: bool
    head: bytes
    tail: bytes


def _begins(chunk: bytes) -> np.ndarray:
    return (np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80


class Summaries(dict):
    """Summary by content; forgets all when it is full."""

    def __init__(self):
        self._bytes = 0

    def __missing__(self, chunk: bytes) -> Summary:
        s = Summary(int(_begins(chunk).sum()), any(x in chunk for x in SENTINELS), chunk[:REACH], chunk[-REACH:])
        if self._bytes > CACHED_BYTES:
            self.clear()
            self._bytes = 0
        self._bytes += len(chunk) + 200
        self[chunk] = s
        return s


class Document:
    """A text as chunks with running counts."""

    def __init__(self, text: bytes, cache: Summaries):
        self.text, self.ends = text, chunk_ends(text)
        self.starts = [0, *self.ends[:-1]]
        before, carried, self.points, self.sentinel = [], b"", 0, False
        for a, b in zip(self.starts, self.ends):
            s = cache[text[a:b]]
            before.append(self.points)
            self.points += s.points
            self.sentinel = self.sentinel or s.sentinel or any(x in carried + s.head for x in SENTINELS)
            carried = (carried + s.tail)[-REACH:]
        self.before = np.array(before)

    def byte_of(self, point: int) -> int:
        """Byte at which code point number ``point`` begins; the end of the text after the last."""
        if point >= self.points:
            return len(self.text)
        k = int(np.searchsorted(self.before, point, "right")) - 1  # the last chunk with fewer points before it has the point
        a, b = self.starts[k], self.ends[k]
        return a + int(np.flatnonzero(_begins(self.text[a:b]))[point - self.before[k]])


def transform(doc_id: int | None, text: bytes, cache: Summaries) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix and middle code points, output."""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    d = Document(text, cache)
    n = d.points
    if not n or d.sentinel or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    p, m = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = d.byte_of(p), d.byte_of(m)
    parts = {b"P": text[:a], b"M": text[a:b], b"S": text[b:]}
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    order = (b"S", b"P", b"M") if form == "spm" else (b"P", b"S", b"M")
    return n, form, p, m - p, b"".join(b"<" + k + b">" + parts[k] for k in order)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output."""

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Summaries()
        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"]):
                d = None if pd.isna(d) else int(d)
                rows.append((d, *transform(d, b"" if t is None else bytes(t), cache)))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({c: "Int64" for c in ("doc_id", "n", "prefix_chars", "middle_chars")})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    out = rows.mapInPandas(of_batches, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form"):
    """The text, from output and form alone. Parts hold no sentinel, so the three sentinels cut the output."""
    part = F.split(F.col(output), "<[PSM]>")
    at = {"psm": (1, 3, 2), "spm": (2, 3, 1)}  # prefix, middle, suffix
    whole = lambda f: F.concat(*[F.get(part, F.lit(k)) for k in at[f]])
    return F.when(F.col(form) == "psm", whole("psm")).when(F.col(form) == "spm", whole("spm")).otherwise(F.col(output))


def digests(filled: DataFrame) -> DataFrame:
    """The table with digests in place of the outputs."""
    hexed = lambda c: F.sha2(c.cast("binary"), 256)
    return filled.withColumns({"output_sha256": hexed(F.col("output")), "restored_sha256": hexed(restored())}).drop("output")


OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT doc_id, text, length(text)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS m,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || substring(text, 1, p) || '<S>' || substring(text, m + 1) || '<M>' || substring(text, p + 1, m - p)
        ELSE '<S>' || substring(text, m + 1) || '<P>' || substring(text, 1, p) || '<M>' || substring(text, p + 1, m - p) END AS output FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""
