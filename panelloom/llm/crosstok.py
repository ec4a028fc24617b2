"""Alignment of two tokenizations by whitespace anchors.

An anchor is the place before a single space between two characters that are no whitespace. No
token of either vocabulary holds a space behind such a character, and both tokenizers build tokens
by merging neighbours, so tokens of A (byte-level BPE, over a space and the text) and of B (pieces,
which adds that space itself) both end there, whatever stands around. Anchors cut the text into
windows, whose tokens, groups between shared ends and overlapping pairs follow from the window's
text alone: a window is tokenized and aligned when a Python worker first meets it (those of a
document together) and found by its text afterwards. Bytes of the tokens are checked against the
text; a document with new windows that fail this is tokenized as a whole, as is every document
if a vocabulary has tokens across anchors.

Counts over the whole table: ``align`` keeps the distinct id pairs of each document with their
number (written once), ``pair_counts`` adds them up, and ``scored`` looks the sums up again. The
``LOOKED_UP`` most frequent pairs go to every task as sorted arrays of that bounded size; pairs
beyond them are joined by a shuffle, where no pair can hold more than one in ``LOOKED_UP`` of all
links, so none is hot.

Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no
tokens: zeros and an empty digest. Strings of special tokens are plain text. Repeated rows are
documents of their own; a null id stays null; an empty table gives an empty result; only the two
named columns are read. Memory per task: one Arrow batch of texts and a cache of bounded size.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators.store import written

from .packing import BYTE_LETTER, PLAIN

LOOKED_UP = 1 << 16
CACHED_WINDOWS = 300_000
LONGEST_CACHED = 64  # tokens of both sides of a window
# Fixed value: the pre-token rule of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"  # the piece vocabulary writes a space like this
ANCHOR = re.compile(r" (?=\S)(?<=\S )")
ACROSS = re.compile(r"\S ")


class Side(NamedTuple):
    """One tokenizer: ids of a text with its leading space, length of every token, whether none reaches across an anchor."""

    encode: Callable[[str], bytes | None]
    lengths: np.ndarray
    parts: bool
    names: np.ndarray  # ids in decimal, with a comma and, in the second row, with the mark that ends the side of a group


def _side(encode, token_bytes: list[bytes], mark: str) -> Side:
    lengths = np.array([len(b) for b in token_bytes], np.int64)
    return Side(encode, lengths, not any(ACROSS.search(b.decode(errors="surrogateescape")) for b in token_bytes), np.array([[f"{i}{m}" for i in range(len(lengths))] for m in (",", mark)], object))


def _checked(encode: Callable[[str], list[int]], token_bytes: list[bytes]) -> Callable[[str], bytes | None]:
    """``encode`` as unsigned 32-bit numbers; None where the tokens' bytes are not the text's."""
    known = token_bytes.__getitem__

    def run(text: str) -> bytes | None:
        ids = encode(text)
        return array("I", ids).tobytes() if b"".join(map(known, ids)) == text.encode() else None

    return run


@functools.lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """Byte-level BPE. If ids follow the order of the merges, texts within PLAIN take the faster library with the same ranks."""
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    byte_of = {letter: b for b, letter in BYTE_LETTER.items()}
    vocabulary = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    # A special token cannot come out of a plain text; its own letters stand for it.
    token_bytes = [bytes(byte_of[c] for c in vocabulary[i]) if i in vocabulary else b"" for i in range(max(vocabulary) + 1)]
    slow = fast = _checked(lambda t: tokenizer.encode(t, add_special_tokens=False).ids, token_bytes)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if all(model["vocab"].get(m) == 256 + k for k, m in enumerate(merged)) and len(token_bytes) >= 256 + len(merged):
        ranks = {token_bytes[i]: i for i in range(256 + len(merged))}
        fast = _checked(tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, token_bytes)
    return _side(lambda text: fast(text) if PLAIN.fullmatch(text) else slow(text), token_bytes, "|")


@functools.lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """Pieces; the model writes the first space of a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    token_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    return _side(_checked(lambda text: model.encode(text[1:]), token_bytes), token_bytes, ";")


#: Alignment of one window: its groups as text, their number, its links as packed pairs, one for each overlap, its token numbers.
Window = tuple[str, int, bytes, int, int]


class Windows(dict):
    """Alignments by the window's text without its first space; forgets all when it is full."""

    def __init__(self, left: Side, right: Side):
        self._sides = left, right

    def of(self, text: str) -> list[Window]:
        """The windows of a text; none where a side does not give the text back."""
        left, right = self._sides
        parts = ANCHOR.split(text) if left.parts and right.parts else [text]
        found = list(map(self.get, parts))
        if None in found:
            if len(self) >= CACHED_WINDOWS:
                self.clear()
            new = list(dict.fromkeys([p for p, w in zip(parts, found) if w is None]))
            aligned = align_windows(new, left, right)
            if aligned is None:  # what fails in a window may not fail in the text
                return align_windows([text], left, right) or []
            made = dict(zip(new, aligned))
            self.update((p, w) for p, w in made.items() if w[3] + w[4] <= LONGEST_CACHED)
            found = [w or made[p] for p, w in zip(parts, found)]
        return found


def align_windows(parts: list[str], left: Side, right: Side) -> list[Window] | None:
    """The windows of these texts, tokenized in a row. Each stretch between neighbouring ends of either side lies in one token of A and one of B: a link."""
    a_raw, b_raw = (side.encode("".join([" " + p for p in parts])) for side in (left, right))
    if a_raw is None or b_raw is None:
        return None
    a, b = np.frombuffer(a_raw, "<u4"), np.frombuffer(b_raw, "<u4")
    a_ends, b_ends = np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b])
    ends = np.union1d(a_ends, b_ends)
    in_a, in_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    pairs = (a[in_a].astype(np.int64) << 32 | b[in_b]).tobytes()
    shared = np.flatnonzero((a_ends[in_a] == ends) & (b_ends[in_b] == ends))  # links that end a group
    group_ends = ends[shared]
    a_to, b_to = np.concatenate([[0], in_a[shared] + 1]), np.concatenate([[0], in_b[shared] + 1])  # tokens before each group
    # Ids in the order of the groups' text, each with the mark that follows it.
    a_group, b_group = np.searchsorted(group_ends, a_ends), np.searchsorted(group_ends, b_ends)
    texts = np.empty(len(a) + len(b), object)
    texts[np.arange(len(a)) + b_to[a_group]] = left.names[(group_ends[a_group] == a_ends).astype(int), a]
    texts[np.arange(len(b)) + a_to[b_group + 1]] = right.names[(group_ends[b_group] == b_ends).astype(int), b]
    texts = texts.tolist()
    window_ends = np.cumsum([len(p.encode()) + 1 for p in parts])
    link_to = [0, *(8 * (np.searchsorted(ends, window_ends) + 1)).tolist()]
    groups = np.concatenate([[0], np.searchsorted(group_ends, window_ends) + 1])
    group_to, a_to, b_to = groups.tolist(), a_to[groups].tolist(), b_to[groups].tolist()
    return [
        ("".join(texts[a0 + b0 : a1 + b1])[:-1], g1 - g0, pairs[l0:l1], a1 - a0, b1 - b0)
        for g0, g1, l0, l1, a0, a1, b0, b1 in zip(group_to, group_to[1:], link_to, link_to[1:], a_to, a_to[1:], b_to, b_to[1:])
    ]


class Aligned(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups_sha256: str
    pairs: np.ndarray
    counts: np.ndarray


NOTHING = Aligned(0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))


def windows_of(text: str, left: Side, right: Side, cache: Windows) -> tuple[int, int, list[Window]]:
    """Token numbers of both sides and the aligned windows of a text; no windows where a side does not give the text back."""
    found = cache.of(text)
    return sum([w[3] for w in found]), sum([w[4] for w in found]), found


def align_text(text: str | None, left: Side, right: Side, cache: Windows) -> Aligned:
    n_a, n_b, found = windows_of(text, left, right, cache) if text else (0, 0, [])
    if not found:
        return NOTHING
    links = np.frombuffer(b"".join([w[2] for w in found]), np.int64)
    pairs, counts = np.unique(links, return_counts=True)
    digest = hashlib.sha256(";".join([w[0] for w in found]).encode()).hexdigest()
    return Aligned(n_a, n_b, sum([w[1] for w in found]), len(links), digest, pairs, counts)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int64)))


FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def align(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: token, group and link numbers, digest of the groups, distinct pairs and their counts.

    A pair is (A id << 32 | B id).
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_side(byte_path), piece_side(piece_path)
        cache = Windows(left, right)
        for batch in batches:
            # Texts are decoded one at a time, so a batch is held once. Nothing made here refers to
            # itself, and searching the many small cached objects for cycles takes a third of the time.
            gc.disable()
            rows = [align_text(t.as_py(), left, right, cache) for t in batch.column(1)]
            gc.enable()
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            columns = [batch.column(0), *numbers, pa.array([r.groups_sha256 for r in rows], pa.string()), _lists([r.pairs for r in rows]), _lists([r.counts for r in rows])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(of_batches, f"{FOUND}, pairs array<long>, counts array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of the whole table that hold the pair; whether that is the highest number of its B id."""
    rows = aligned.select(F.inline(F.arrays_zip("pairs", "counts")))
    counts = rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    counts = written(counts, "pair-counts")
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("b", b).join(highest, "b")
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of its pairs."""
    spark = aligned.sparkSession
    top = counts.orderBy(F.desc("n"), "pair").limit(LOOKED_UP).toPandas().sort_values("pair")
    known = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            lists, numbers = batch.column("pairs"), batch.column("counts")
            at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            pair, count = lists.flatten().to_numpy(zero_copy_only=False), numbers.flatten().to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[place] == pair if len(pairs) else np.zeros(len(pair), bool)
            place = place[hit]
            rows = np.repeat(np.arange(len(batch)), np.diff(at))
            sums = np.zeros((2, len(batch)), np.int64)
            np.add.at(sums[0], rows[hit], count[hit] * best[place])
            np.add.at(sums[1], rows[hit], count[hit] * n[place])
            left = np.concatenate([[0], np.cumsum(np.bincount(rows[~hit], minlength=len(batch)))])
            rest = lambda v: pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(v[~hit]))
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums[0]), pa.array(sums[1]), rest(pair), rest(count)], names=[*names, "n_best", "count_sum", "pairs", "counts"])

    names = [c.split()[0] for c in FOUND.split(", ")]
    first = aligned.select(*names, "pairs", "counts").mapInArrow(of_batches, f"{FOUND}, n_best long, count_sum long, pairs array<long>, counts array<long>")
    first = written(first.withColumn("row", F.monotonically_increasing_id()), "pairs-looked-up")
    if counts.count() <= LOOKED_UP:
        return first.drop("pairs", "counts", "row")
    rest = first.select("row", F.inline(F.arrays_zip("pairs", "counts")))
    rest = rest.join(counts, rest["pairs"] == counts["pair"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("counts")).otherwise(0)).alias("more_best"), F.sum(F.col("counts") * F.col("n")).alias("more")
    )
    add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return first.join(rest, "row", "left").select(*names, add("n_best", "more_best"), add("count_sum", "more"))


def cross_align(docs: DataFrame, byte_path: str, piece_path: str, **columns) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = written(align(docs, byte_path, piece_path, **columns), "aligned")
    return scored(aligned, written(pair_counts(aligned), "pair-table"))
