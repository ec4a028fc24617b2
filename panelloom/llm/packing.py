"""Packing by power-of-two decomposition.

A document's token count is written in binary: first as many pieces of ``max_length`` tokens as
fit, then one piece for each set bit of the rest, longest first. Every piece is a sequence of
its own, so no sequence crosses documents; its length is a power of two, so none is padded.
Pieces of equal length share a bucket, from which batches are drawn. The work is one pass over
the documents without a shuffle; a task holds one Arrow batch of documents at a time.

A document is its ids by the tokenizer (special strings in a text become their ids, as the
library does by default), then ``end_id``. Null and empty texts are the end id alone. Repeated
rows are packed once each; a null id stays null. An empty table gives no pieces. Only the two
named columns are read.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 1
MAX_LENGTH = 2048
CACHED_WORDS = 400_000
#: Lower bits of a sequence id where positions are given: the piece in its document, above it the position.
PIECE_BITS, POSITION_BITS = 20, 37

# The pre-token rule of the byte-level vocabulary, for the characters of PLAIN,
# in which every letter lies in LETTER, every number in NUMBER and every blank in BLANK.
PLAIN = re.compile(r"[\x00-ɏ‐-‧‰-⁞€]*")
LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
BLANK = r"\t-\r \x85\xa0"
WORD = re.compile(
    rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTER = _byte_letters()


class _WordIds(dict):
    """Little-endian ids of a pre-token, by the tokenizer; forgets all when it is full."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self._encode(word)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) < 64:
            self[word] = out
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """Text to little-endian unsigned 32-bit ids, exactly those of the library.

    Words repeat, so ids are cached by pre-token, for all tasks of a Python worker. Texts with
    characters outside PLAIN or with a special string go to the library as a whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def library(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    merge = tokenizer.model.tokenize
    words = _WordIds(lambda word: [t.id for t in merge(word.encode().decode("latin-1").translate(BYTE_LETTER))])

    def encode(text: str) -> bytes:
        if PLAIN.fullmatch(text) and not any(s in text for s in special):
            return b"".join(map(words.__getitem__, WORD.findall(text)))
        ids = library(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    return encode


def binary_lengths(tokens: int, max_length: int = MAX_LENGTH) -> list[int]:
    """``max_length`` as often as it fits, then the set bits of the rest, longest first."""
    full, rest = divmod(tokens, max_length)
    return [max_length] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
           max_length: int = MAX_LENGTH, end_id: int = END_ID, digest: bool = False, position: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens.

    With ``digest`` the ids are replaced by ``ids_crc32``, so that they never leave the task.
    The column ``position``, if named, is carried along.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows, at_position = [], []
            for k, (d, t) in enumerate(zip(batch["doc_id"], batch["text"])):
                ids = (encode(t) if isinstance(t, str) else b"") + end
                n, at = len(ids) // 4, 0
                d = None if pd.isna(d) else int(d)
                for length in binary_lengths(n, max_length):
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((d, at, length, zlib.crc32(part) if digest else part, n))
                    at += length
                    at_position.append(k)
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            if position:
                out["position"] = batch["position"].to_numpy()[np.array(at_position, int)]
            yield out

    schema = PIECES.replace("ids binary", "ids_crc32 long") if digest else PIECES
    carried = [F.col(position).cast("long").alias("position")] if position else []
    schema += ", position long" if position else ""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *carried).mapInPandas(cut, schema)


def pack(docs: DataFrame, tokenizer_path: str, position: str | None = None, **options) -> DataFrame:
    """``pieces`` as sequences: bucket (log2 of the length), sequence_id, offset.

    The upper bits of a sequence id are its bucket, the lower ones count pieces by partition, so
    ids sort by bucket and no counting pass is needed. Where the column ``position`` is named, the
    lower bits are the document's position and the piece's number, so that ids follow the positions
    inside each bucket.
    """
    bucket = F.length(F.bin("length")).cast("long") - 1
    number = F.monotonically_increasing_id()
    if position:
        piece = F.floor(F.col("start") / options.get("max_length", MAX_LENGTH))
        fits = (F.col("position") < 1 << POSITION_BITS) & (piece < 1 << PIECE_BITS)
        number = F.when(fits, F.shiftleft("position", PIECE_BITS) + piece).otherwise(F.raise_error(F.lit("position or piece number too large for a sequence id")))
    return pieces(docs, tokenizer_path, position=position, **options).withColumns({
        "bucket": bucket,
        "sequence_id": F.shiftleft(bucket, 57) + number,
        "offset": F.lit(0).cast("long"),
    }).drop(*["position"] if position else [])
