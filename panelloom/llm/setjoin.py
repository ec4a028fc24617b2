"""N-gram Jaccard join with set-relation skipping.

Documents become sets of word shingles; two link when their Jaccard similarity reaches
``num / den``, compared in whole numbers. The result is each document's connected component.

Identical sets are one set from the start. The others meet by signatures. Sets of a size class that link
differ in at most K shingles, so if the range of the shingle hashes is cut into K + 1 parts, one part
at least holds the same shingles in both. A set names the content of each of its parts, for its own size
class and, if it is short enough, for the class below. No frequency of any shingle is needed, and sets that
share a part share all of its shingles, several as a rule, so boilerplate alone brings few sets together.
A part without shingles says nothing: E parts more than K + 1 leave each set with at most E empty parts a
part that does; a set with more empty parts names these too, and such sets meet there.

Among the sets of one signature, a block, answers are derived from a similar set's answers. In each round every
block names one pivot; a set is compared with one of the pivots of its blocks, the nearest by parity sketch, and a
set that links with a pivot takes over its component, so it needs no comparison with other members.
Members of one component are never compared, so a group of near copies costs a comparison per copy and
round instead of one per pair, and each round's comparisons are at most one per set. Rounds go on while they
link many sets; then all remaining pairs of different components in a block are compared.
Every pair that could link is thus compared or already connected: no link is lost.

A parity sketch says of each of ``PARITY_BITS`` cells whether an odd number of a set's shingles falls into it.
Two sets differ in at least as many shingles as their sketches differ in cells, so a pair whose sketches are too
far apart is skipped inside the join, before it becomes a row.

Signatures are shuffled in a few passes, each with a share of them, and deleted once the shared ones are known;
rounds move set and block names alone, and sketches once per pair. So the disk in use stays near what the signatures take.

Comparisons are exact: both texts meet in one row and their shingle sets are intersected.
Shingles are compared by 64-bit hashes. Texts move only for sets that share a signature.

Null text, and texts without words, have empty sets and link with nothing; texts with fewer words than a shingle
have one shingle, the whole sequence. A null doc_id is not linked and has a null component.
Rows that share a doc_id are one document. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.store import new_path, remove, written

from .common import fresh, lower_ascii, salted_left_join, whole_text

#: Bits of the filters: a fixed size, whatever the input.
FILTER_BITS = 1 << 25
BITMAP_BITS = 32_768
#: Counts of a set's shingles by bucket bound what two sets can share.
BUCKETS = 32
#: Cells of the parity sketch, in words of 64.
PARITY_BITS = 512
#: Rows whose sets are held at once.
SLICE = 512
#: Signatures are shuffled in so many goes, each with a share of them and done with before the next.
PASSES = 4
#: Sets per block in which pairs are compared.
BLOCK_SETS = 256
MAX_ROUNDS = 24
#: Rounds of pivots go on while one links at least one set in this many.
WORTHWHILE = 50


@dataclass(frozen=True)
class Rule:
    """Shingles of ``n`` words; sets link when den * shared >= num * union."""

    n: int = 3
    num: int = 9
    den: int = 10

    def sizes_can_link(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * F.lit(self.den) >= F.greatest(a, b) * F.lit(self.num)

    def differences_can_link(self, differ: Column, sizes: Column) -> Column:
        """Sets with ``sizes`` shingles together link only if at most this many of them are in one set alone."""
        return differ * F.lit(self.num + self.den) <= sizes * F.lit(self.den - self.num)


def word_hashes(text: str = "text") -> Column:
    """64-bit hashes of the words of a text, in order."""
    words = F.split(lower_ascii(whole_text(text)), r"[ \t-\r]+")
    return F.transform(F.filter(words, lambda x: x != ""), lambda x: F.xxhash64(x))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(words: pa.ListArray, n: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each row of word hashes."""
    words = words.fill_null([]) if words.null_count else words
    ends = words.offsets.to_numpy().astype(np.int64)
    h = words.values.to_numpy(zero_copy_only=False).view(np.uint64)[ends[0] : ends[-1]]  # a slice holds the values of all
    ends = ends - ends[0]
    size = len(h) - n + 1
    grams = np.zeros(max(0, size), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            grams = _mixed(grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + size]) if size > 0 else grams
        out = []
        for s, e in zip(ends[:-1], ends[1:]):
            if e - s >= n:
                out.append(np.unique(grams[s : e - n + 1].view(np.int64)))
            else:
                whole = np.zeros(1, np.uint64)
                for k in range(s, e):
                    whole = _mixed(whole * np.uint64(0x9E3779B97F4A7C15) + h[k])
                out.append(whole.view(np.int64) if e > s else np.zeros(0, np.int64))
    return out


def set_id(tokens: np.ndarray) -> int:
    """64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity(tokens: np.ndarray) -> np.ndarray:
    """The parity sketch of a set: one bit per cell."""
    odd = np.bincount((tokens >> np.int64(20)) & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def cells_apart(a: str, b: str) -> Column:
    """In how many cells two parity sketches differ: no more than the sets differ in shingles."""
    words = [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(PARITY_BITS // 64)]
    return sum(words[1:], words[0])


@functools.lru_cache(maxsize=8)
def size_classes(rule: Rule, size: int) -> list[int]:
    """The largest size of each class, up to one that holds ``size``. Sizes that can link lie in one class or in neighbours."""
    tops = [1]
    while tops[-1] < size:
        tops.append(max(tops[-1] + 1, (tops[-1] + 1) * rule.den // rule.num))
    return tops


class Parts(NamedTuple):
    """How the sets of a size class are cut: where parts begin (and end), the salt of each, how many may be empty."""

    edges: np.ndarray
    salts: np.ndarray
    empty: int


@functools.lru_cache(maxsize=1024)
def parts_of(rule: Rule, least: int, most: int) -> Parts | None:
    """For pairs whose smaller set has ``least`` to ``most`` shingles; None if only equal sets link.

    Such a pair differs in at most K = most * (den - num) / num shingles. Of K + 1 + E parts at least E + 1 are
    equal; E is the number of empty parts to be expected, and three deviations more.
    """
    differ = most * (rule.den - rule.num) // rule.num
    if not differ:
        return None
    n = differ + 1
    for _ in range(20):
        mean = n * math.exp(-least / n)
        n = max(n, differ + 1 + (math.ceil(mean + 3 * math.sqrt(mean)) if mean > 0.02 else 0))
    edges = np.array([(j << 64) // n - (1 << 63) for j in range(n)], np.int64)
    salts = _mixed(np.arange(n, dtype=np.uint64) + np.uint64(most << 32))
    return Parts(edges, salts, n - differ - 1)


def signatures(tokens: np.ndarray, rule: Rule) -> np.ndarray:
    """Names of the parts of a set: two sets that link and are not equal have one in common."""
    m, out = len(tokens), [np.zeros(0, np.int64)]
    tops = size_classes(rule, 1 << max(1, m - 1).bit_length())
    own = bisect.bisect_left(tops, m)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.view(np.uint64))])
    for c in (own, own - 1):
        # In the class below it meets smaller sets, if they are large enough.
        if c < 0 or m * rule.num > tops[c] * rule.den or not (parts := parts_of(rule, tops[c - 1] + 1 if c else 1, tops[c])):
            continue
        at = np.append(np.searchsorted(tokens, parts.edges), m)
        names = _mixed(np.diff(sums[at]) + parts.salts)
        held = at[1:] > at[:-1]
        out.append((names if len(held) - held.sum() > parts.empty else names[held]).view(np.int64))
    return np.concatenate(out)


def sketch_rows(rule: Rule, words: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its set's name, size, bucket counts, parity sketch and signatures (of equal sets in a task only the first has them)."""
    seen: set[int] = set()
    # Few rows at a time: what is made of them takes several times the memory of their words.
    for b in (whole.slice(at, SLICE) for whole in words for at in range(0, whole.num_rows, SLICE)):
        sets = shingle_sets(b.column("words"), rule.n)
        sids = [set_id(t) if len(t) else None for t in sets]
        names = []
        for t, sid, doc_id in zip(sets, sids, b.column("doc_id").to_pylist()):
            new = sid is not None and doc_id is not None and sid not in seen
            names.append(signatures(t, rule) if new else np.zeros(0, np.int64))
            if new:
                seen.add(sid)
        ends = np.cumsum([0, *map(len, names)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), b.column("h"), pa.array(sids, pa.int64()), pa.array([len(t) for t in sets], pa.int64()),
            pa.array([np.bincount((t >> np.int64(40)) & (BUCKETS - 1), minlength=BUCKETS).astype(np.int32) for t in sets], pa.list_(pa.int32())),
            pa.array([parity(t) for t in sets], pa.list_(pa.int64())),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *names]))),
        ], names=["doc_id", "h", "sid", "m", "buckets", "parity", "signatures"])


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(token, sid) of the signatures that two sets or more have in common.

    Few are, so what is kept of a pass is small, and only a pass's share of the signatures is on disk at once.
    """
    all_of, out = Window.partitionBy("token"), None
    for k in range(PASSES):
        named = rows.select(F.explode("signatures").alias("token"), "sid").where(F.pmod("token", F.lit(PASSES)) == k)
        both = named.withColumn("lo", F.min("sid").over(all_of)).withColumn("hi", F.max("sid").over(all_of))
        part = written(both.where("lo < hi").select("token", "sid").distinct(), "join-index")
        out = part if out is None else out.union(part)
    return out


def keep_listed(df: DataFrame, column: str, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` may occur in ``listed``: a bitmap filter of at most FILTER_BITS, so it can always be broadcast.

    It only saves shuffling: rows that pass without being listed are dropped by the join behind it.
    """
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    cell, bits = fresh(df, "cell", "bits")
    maps = listed.select(h(F.col(key)).alias("h")).groupBy(F.floor(F.col("h") / BITMAP_BITS).alias(cell)).agg(
        F.bitmap_construct_agg(F.col("h") % BITMAP_BITS).alias(bits)
    )
    bit = h(F.col(column)) % BITMAP_BITS
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0
    return df.withColumn(cell, F.floor(h(F.col(column)) / BITMAP_BITS)).join(F.broadcast(maps), cell).where(hit).drop(cell, bits)


def may_link(pairs: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose bucket counts allow a link, with the bound on what they share.

    Two sets share at most the sum over buckets of the smaller count; counts are whole, whatever the size of a set.
    """
    left = pairs.join(sizes.select(F.col("sid").alias("a"), F.col("m").alias("m_a"), F.col("buckets").alias("n_a")), "a")
    both = left.join(sizes.select(F.col("sid").alias("b"), F.col("m").alias("m_b"), F.col("buckets").alias("n_b")), "b")
    bound = F.aggregate(F.zip_with("n_a", "n_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = both.select("a", "b", bound.alias("bound"), (F.col("m_a") + F.col("m_b")).alias("sum"))
    return rows.where(F.col("bound") * (rule.num + rule.den) >= F.col("sum") * rule.num).withColumn("bound", F.col("bound") / F.col("sum")).drop("sum")


def pivot_units(pairs: DataFrame) -> DataFrame:
    """(unit, a, b) of pairs (x, y) with at most one y per x: a unit is a pivot y and some ``BLOCK_SETS`` of its x.

    So the text of x moves once, and that of a pivot once per unit.
    """
    counts = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("n"))
    cut = salted_left_join(pairs, counts, "y", F.col("x"))
    unit = F.concat_ws(":", "y", F.pmod(F.xxhash64("x"), F.col("n")))
    return cut.select(unit.alias("unit"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def cluster_units(pairs: DataFrame) -> DataFrame:
    """(unit, a, b) of any pairs, grouped by clusters (sets connected by pairs).

    A cluster is cut into blocks of about ``BLOCK_SETS`` sets. One unit of work holds the pairs
    between two blocks, so a text moves once per block it is compared with, not once per pair,
    and no unit grows with its cluster.
    """
    clusters = components(pairs, None)
    counts = clusters.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("n"))
    blocks = salted_left_join(clusters, counts, "comp", F.col("sid"))
    blocks = written(blocks.select("sid", "comp", F.pmod(F.xxhash64("sid"), F.col("n")).alias("block")), "join-blocks")
    of = lambda side: blocks.select(F.col("sid").alias(side), "comp", F.col("block").alias(f"block_{side}"))
    placed = pairs.select("a", "b").join(of("a"), "a").join(of("b").drop("comp"), "b")
    unit = F.concat_ws(":", "comp", F.least("block_a", "block_b"), F.greatest("block_a", "block_b"))
    return placed.select(unit.alias("unit"), "a", "b")


def compare(placed: DataFrame, docs: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of sets that link. ``placed`` says in which unit of work a pair is compared; ``sizes`` names a document of each set."""
    placed = written(placed, "join-units")
    needed = placed.select("unit", F.explode(F.array("a", "b")).alias("sid")).distinct()
    needed = written(needed.join(sizes.select("sid", "rep", "h"), "sid"), "join-needed")
    texts = keep_listed(docs.select(F.col("doc_id").alias("rep"), "text"), "rep", needed, "rep")
    texts = texts.select("rep", F.xxhash64(whole_text()).alias("h"), whole_text().cast("binary").alias("text"))
    # Rows that share a doc_id may bring another text; the hash picks the one that was indexed.
    texts = needed.join(texts.dropDuplicates(["rep", "h"]), ["rep", "h"]).select("unit", "sid", "text")

    def links(unit_pairs: pd.DataFrame, unit_texts: pd.DataFrame) -> pd.DataFrame:
        words = [t.lower().split() for t in unit_texts["text"]]
        ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
        # Hashes of one process suffice here, since both sets of a pair are in this unit.
        flat = np.fromiter((hash(w) for t in words for w in t), np.int64, ends[-1])
        sets = dict(zip(unit_texts["sid"], shingle_sets(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), rule.n)))
        hit = []
        for a, b in zip(unit_pairs["a"], unit_pairs["b"]):
            x, y = sets[a], sets[b]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if rule.den * shared >= rule.num * (len(x) + len(y) - shared):
                hit.append((a, b))
        return pd.DataFrame(hit, columns=["a", "b"], dtype="int64")

    return placed.groupBy("unit").cogroup(texts.groupBy("unit")).applyInPandas(links, "a long, b long")


def components(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(sid, comp): the smallest sid connected, by minimum labels and pointer jumping; ``labels`` is a start."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "join-edges")
    # A set keeps its former label to begin with: through it the label's other owners hear of new links.
    now = both.select(F.col("a").alias("sid"), F.col("a").alias("comp")).distinct()
    if labels is not None:
        now = now.union(labels).groupBy("sid").agg(F.min("comp").alias("comp"))
    now = written(now, "join-labels")
    # Labels only fall, so equal sums mean that none did.
    total = lambda labels: labels.agg(F.sum(F.col("comp").cast("decimal(38,0)")).alias("s")).first()["s"]
    before = total(now)
    while True:
        seen = both.join(now.select(F.col("sid").alias("b"), "comp"), "b").select(F.col("a").alias("sid"), "comp")
        # The label's own label, and back to the label's owner, so that chains shrink by halves.
        up = now.select(F.col("sid").alias("comp"), F.col("comp").alias("top"))
        jumped = now.join(up, "comp").select("sid", F.col("top").alias("comp"))
        hooked = seen.join(now.withColumnRenamed("comp", "own"), "sid").where("comp < own").select(F.col("own").alias("sid"), "comp")
        new = now.union(seen).union(jumped).union(hooked).groupBy("sid").agg(F.min("comp").alias("comp"))
        now = written(new, "join-labels")
        after = total(now)
        if after == before:
            return now
        before = after


def linked_sets(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sid, m) of every row, and (sid, comp) of every set that links with another set."""
    first = docs.select("doc_id", F.xxhash64(whole_text()).alias("h"), word_hashes().alias("words")).mapInArrow(
        partial(sketch_rows, rule), "doc_id long, h long, sid long, m long, buckets array<int>, parity array<long>, signatures array<long>"
    )
    path = new_path(docs.sparkSession, "join-signatures")
    first = written(first, "join-signatures", path)
    keys = written(first.select("doc_id", "sid", "m"), "join-keys")
    index = shared_signatures(first)
    sizes = first.where("sid is not null and doc_id is not null").select("doc_id", "h", "sid", "m", "buckets", "parity")
    # Sets with many shared signatures are the typical ones.
    sizes = sizes.join(index.groupBy("sid").agg(F.count(F.lit(1)).alias("shared")), "sid")
    sizes = sizes.groupBy("sid").agg(
        F.min(F.struct("doc_id", "h")).alias("d"), *[F.min(c).alias(c) for c in ("m", "buckets", "parity", "shared")]
    ).select("sid", F.col("d.doc_id").alias("rep"), "d.h", "m", "buckets", "parity", "shared")
    sizes = written(sizes, "join-sizes")
    remove(docs.sparkSession, path)  # larger than all that follows
    named_sets = sizes.count()
    labels, tested, last = None, None, False
    for k in range(MAX_ROUNDS + 1):
        last = last or k == MAX_ROUNDS
        now = _with_components(index, sizes, labels)
        if last:
            mixed = written(_mixed_blocks(now), "join-mixed")
            pairs = _all_pairs(mixed.join(sizes.select("sid", "m", "parity"), "sid"), rule)
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = written(may_link(pairs, sizes, rule).select("a", "b"), "join-pairs")
            placed = cluster_units(pairs)
        else:
            # One partner per set and round, the nearest: its component's answers are then the set's own.
            partners = written(_partners(now, sizes, tested, rule, k), "join-pairs")
            pairs = partners.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            placed = pivot_units(partners)
        links = written(compare(placed, docs, sizes, rule).distinct(), "join-links")
        found = links.count()
        if found:
            labels = components(links, labels)
        if last:
            break
        last = found * WORTHWHILE < named_sets
        tested = pairs if tested is None else tested.union(pairs)
    return keys, labels if labels is not None else docs.sparkSession.createDataFrame([], "sid long, comp long")


def _with_components(index: DataFrame, sizes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Index entries of sets with their component."""
    of = sizes.select("sid", "shared")
    if labels is not None:
        of = of.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    else:
        of = of.withColumn("comp", F.col("sid"))
    return index.join(of, "sid")


def _mixed_blocks(now: DataFrame) -> DataFrame:
    """The entries of blocks that hold several components."""
    mixed = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return now.select("token", "sid", "comp").join(mixed, "token")


def _can_link(rule: Rule) -> Column:
    return rule.sizes_can_link(F.col("m"), F.col("m_q")) & rule.differences_can_link(cells_apart("parity", "parity_q"), F.col("m") + F.col("m_q"))


def _partners(now: DataFrame, sizes: DataFrame, tested: DataFrame | None, rule: Rule, k: int) -> DataFrame:
    """(x, y): each set with the nearest pivot of its blocks.

    Even rounds take the most typical set of a block as its pivot, that with the most shared signatures; odd rounds any.
    Sets that are near share many blocks, so sketches are looked up for distinct pairs, not moved with every entry.
    """
    order = F.xxhash64("sid", F.lit(k)) if k % 2 else F.struct(-F.col("shared"), F.xxhash64("sid", F.lit(k)))
    pivots = now.groupBy("token").agg(F.min(F.struct(order, "sid", "comp")).alias("q")).select("token", F.col("q.sid").alias("y"), F.col("q.comp").alias("comp_q"))
    near = now.select("token", F.col("sid").alias("x"), "comp").join(pivots, "token").where("comp <> comp_q").select("x", "y").distinct()
    if tested is not None:
        both = tested.select(F.col("a").alias("x"), F.col("b").alias("y")).union(tested.select(F.col("b").alias("x"), F.col("a").alias("y")))
        near = near.join(both, ["x", "y"], "left_anti")
    near = near.join(sizes.select(F.col("sid").alias("x"), "m", "parity"), "x")
    near = near.join(sizes.select(F.col("sid").alias("y"), F.col("m").alias("m_q"), F.col("parity").alias("parity_q")), "y").where(_can_link(rule))
    near = near.select("x", "y", (cells_apart("parity", "parity_q") / (F.col("m") + F.col("m_q"))).alias("far"))
    return near.groupBy("x").agg(F.min(F.struct("far", "y")).alias("best")).select("x", "best.y")


def _all_pairs(now: DataFrame, rule: Rule) -> DataFrame:
    """All pairs (a, b) of different components in a block that can link.

    Sets of the block's largest component do not ask; the others ask these and, by name, each other.
    """
    parts = now.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("token")
    mixed = parts.agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("token", F.col("top.comp").alias("top"))
    asking = now.join(mixed, "token").where("comp <> top")
    asked = now.select("token", *[F.col(x).alias(f"{x}_q") for x in ("sid", "m", "comp", "parity")])
    pairs = asking.join(asked, "token").where((F.col("comp_q") == F.col("top")) | (F.col("sid") < F.col("sid_q"))).where("comp <> comp_q").where(_can_link(rule))
    return pairs.select(F.least("sid", "sid_q").alias("a"), F.greatest("sid", "sid_q").alias("b")).distinct()


def classes(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id connected)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keys, labels = linked_sets(rows, rule)
    linked = salted_left_join(keys, labels, "sid", F.col("doc_id")).withColumn("comp", F.coalesce("comp", "sid"))
    least = linked.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    out = salted_left_join(linked, least.where("n > 1").drop("n"), "comp", F.col("doc_id"))
    # A group of rows without ids has no smallest id; a row without id belongs to none.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("m").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; rows without id stay."""
    (gone,) = fresh(docs, "gone")
    drop = classes(docs, rule, doc_id, text).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(drop, F.col(doc_id) == F.col(gone), "left_anti")
