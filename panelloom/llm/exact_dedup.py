"""Exact deduplication by two-pass Bloom filtering.

Texts are equal when identical after lower-casing A-Z. The first pass hashes every text to two
bits of one block of a Bloom filter and keeps the bits that at least two rows hit; blocks are
bitmaps of 32,768 bits. In the second pass only rows whose bits are all hit twice can be
repeated: they alone are shuffled and compared by SHA-256, all others pass straight through.

The filter has 16 bits per row. It is broadcast while it is at most ``filter_bytes``; beyond
that the blocks are joined by block number, with the same result.

Null text counts as empty. A null id ranks below all others. Rows equal in id and text are the
same document: ``mark`` gives them the same answer and ``deduplicate`` returns one of them. An
empty table gives an empty result. Columns of any name are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.operators.store import written

from .common import fresh, lower_ascii, salted_left_join, whole_text

BLOCK_BITS = 32_768
BITS_PER_ROW = 16
FILTER_BYTES = 64 << 20


def _cells(h: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block number and two bit numbers inside it, from one 64-bit hash."""
    return (
        F.pmod(h, F.lit(blocks)),
        F.shiftrightunsigned(h, 49).cast("long"),
        F.shiftrightunsigned(F.xxhash64(h), 49).cast("long"),
    )


def _bit(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0, F.lit(False))


def repeated_bits(hashes: DataFrame, blocks: int) -> DataFrame:
    """The second filter: for each block the bitmap of bits that two or more rows hit."""
    block, one, two = _cells(F.col("h"), blocks)
    hits = hashes.select(block.alias("block"), F.explode(F.array(one, two)).alias("bit")).groupBy("block", "bit").count()
    return hits.where("count > 1").groupBy("block").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))


def flag_candidates(docs: DataFrame, text: str = "text", filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with a boolean column (its name is returned): may another row have an equal text?"""
    rows = docs.count()
    blocks = max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))
    # Full lower-casing merges a superset of what A-Z lower-casing merges, and is cheaper.
    h = F.xxhash64(F.lower(whole_text(text)))
    twice = written(repeated_bits(docs.select(h.alias("h")), blocks), "bloom")
    hash_, block, bits, flag = fresh(docs, "hash", "block", "bits", "flag")
    twice = twice.select(F.col("block").alias(block), F.col("bits").alias(bits))
    if blocks * BLOCK_BITS // 8 <= filter_bytes:
        twice = F.broadcast(twice)
    keyed = docs.withColumn(hash_, h).withColumn(block, F.pmod(F.col(hash_), F.lit(blocks)))
    _, one, two = _cells(F.col(hash_), blocks)
    hit = _bit(F.col(bits), one) & _bit(F.col(bits), two)
    out = keyed.join(twice, block, "left").withColumn(flag, hit).drop(hash_, block, bits)
    return out, flag


def mark(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    flagged, flag = flag_candidates(narrow, "text", filter_bytes)
    sha = F.sha2(lower_ascii(whole_text()).cast("binary"), 256)
    keys = written(flagged.select("doc_id", sha.alias("text_sha256"), F.col(flag).alias("candidate")), "exact-keys")
    alone, again = keys.where("not candidate").drop("candidate"), keys.where("candidate").drop("candidate")
    groups = again.groupBy("text_sha256").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = salted_left_join(again, groups, "text_sha256", F.col("doc_id"))
    both = alone.withColumns({"top": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}).unionByName(joined)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return both.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the largest id.

    Rows the filter clears are not shuffled. Of the rest only digest and id are grouped; their
    whole rows move once, to meet the digest of the row that stays.
    """
    flagged, flag = flag_candidates(docs, text, filter_bytes)
    sha, top = fresh(flagged, "sha", "top")
    digest = F.sha2(lower_ascii(whole_text(text)).cast("binary"), 256)
    alone, again = flagged.where(~F.col(flag)).drop(flag), flagged.where(flag).drop(flag).withColumn(sha, digest)
    best = again.groupBy(sha).agg(F.max(doc_id).alias(top))
    # (digest, id) names the row that stays, so a hot digest loses its other rows before the join output.
    stays = again.join(best.withColumnRenamed(sha, f"{sha}_b"), (F.col(sha) == F.col(f"{sha}_b")) & F.col(doc_id).eqNullSafe(F.col(top)), "left_semi")
    return alone.unionByName(stays.dropDuplicates([sha]).drop(sha))


OP5_SQL = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
