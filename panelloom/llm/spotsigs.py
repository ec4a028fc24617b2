"""Document fingerprints by spot signatures.

Wherever a common word (an anchor) stands, the anchor and the next ``CHAIN`` content words form a
spot signature; content words are all words that are no anchors. The first ``HEAD_WORDS`` words of a
text and words ``FAR_FROM_ANCHOR`` or more behind the last anchor are anchors too, so that short
texts and texts without common words are covered; that is decided locally, so an edit changes
signatures near it only. A fingerprint is the set of a text's signatures, 32-bit hashes in
ascending order; a text without words is one signature of itself. Likeness is the Jaccard
similarity of two sets; two empty sets (empty texts) are alike.

Sets are compared through pruned Jaccard: the ratio of their lengths bounds their likeness, so a
pair in partitions of set length too far apart for ``floor`` is 0 without looking at the members.

Words are runs of letters and digits, in lower case. Null text counts as empty. Rows equal in
doc_id and text are the same document; documents are ordered by (doc_id, hash of the text),
null ids first, and the first follows the last. An empty table gives an empty result. Extra
columns are ignored. Everything runs in Spark's own functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.store import written

from .common import whole_text

CHAIN = 2
HEAD_WORDS = 24
FAR_FROM_ANCHOR = 6
EDIT_SHARE = 4
#: Pairs that set lengths alone keep under this likeness are 0 and not compared.
PRUNE_BELOW = 0.05

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is was it for on are as with at be by this that from or have an they which you were "
    "der die das und ist von zu den mit sich des auf für nicht dem ein eine als auch es im er sie "
    "le la les de et des un une du est que dans qui pour par sur au avec ce pas "
    "el los las y en una por con para del se no su al lo como más"
).split()


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the ascending array<int> of spot signatures of ``text``.

    Anchors cut the words into stretches. In stretch j (from -1, before the first anchor) the word
    s has s - j - 1 content words before it if it is content itself, s - j if it is the anchor:
    either way its chain starts at content word s - j, and no running count is needed.
    """
    w, cuts, content = (f"{out}_{x}" for x in ("words", "cuts", "content"))
    df = df.withColumn(w, words(F.col(text)))
    anchors = F.filter(F.transform(w, lambda x, i: F.when(x.isin(ANCHORS), i)), lambda i: i.isNotNull())
    df = df.withColumns({
        cuts: F.concat(F.array(F.lit(-1)), anchors, F.array(F.size(w))),
        content: F.filter(w, lambda x: ~x.isin(ANCHORS)),
    })

    def stretch(p: Column, k: Column) -> Column:
        start, stop = F.greatest(p, F.lit(0)), F.get(F.col(cuts), k + 1)
        spots = F.filter(F.sequence(start, stop - 1), lambda s: (s == p) | (s >= p + FAR_FROM_ANCHOR) | (s < HEAD_WORDS))
        chain = lambda s: F.hash(F.get(F.col(w), s), *[F.get(F.col(content), s - k + 1 + c) for c in range(CHAIN)])
        return F.when(stop > start, F.transform(spots, chain)).otherwise(F.array().cast("array<int>"))

    signed = F.flatten(F.transform(F.slice(cuts, 1, F.size(cuts) - 1), stretch))
    wordless = F.when(F.col(text) == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(text)))
    whole = F.when(F.size(w) == 0, wordless).otherwise(signed)
    return df.withColumn(out, F.sort_array(F.array_distinct(whole))).drop(w, cuts, content)


def length_partition(size: Column, floor: float) -> Column:
    """Sets whose partitions differ by more than one cannot be ``floor`` alike."""
    width = -math.log(floor) * 1.0001  # a little wider than the ratio, for rounding
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(width)).cast("int")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 where the lengths alone keep it under ``floor``."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    exact = F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))
    if floor <= 0:
        return exact
    apart = F.abs(length_partition(F.size(a), floor) - length_partition(F.size(b), floor)) > 1
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    return F.when(apart | (bound < floor) & (F.size(a) + F.size(b) > 0), F.lit(0.0)).otherwise(exact)


def as_text(signatures: Column) -> Column:
    return F.array_join(signatures.cast("array<string>"), " ")


def predecessors(docs: DataFrame) -> DataFrame:
    """For each document (key, h, n) the one before it: prev(key, h, n); the last stands before the first.

    Ids are sorted by range; each range looks back inside itself, and one row per range (their
    number is the session's shuffle partitions) links the ranges.
    """
    spark = docs.sparkSession
    ids = docs.groupBy("doc_id", "key", "h").agg(F.max("n").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(
        ids.repartitionByRange(parts, "doc_id", "h").withColumn("range", F.spark_partition_id()), "spot-order"
    )
    row = F.struct("doc_id", "h", "key", "n")
    inside = ranged.withColumn("prev", F.lag(row).over(Window.partitionBy("range").orderBy("doc_id", "h")))
    ends = ranged.groupBy("range").agg(F.max(row).alias("last"))
    everywhere = Window.partitionBy(F.lit(0))
    ends = ends.select(
        "range", F.coalesce(F.lag("last").over(everywhere.orderBy("range")), F.max("last").over(everywhere)).alias("before")
    )
    return inside.join(F.broadcast(ends), "range").select("key", "h", F.coalesce("prev", "before").alias("prev"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", floor: float = PRUNE_BELOW) -> DataFrame:
    """Per document: fingerprint, that of its edited text, and likeness to it and to the next document.

    The edited text has the last floor(n / 4) code points replaced by the first as many of the
    next document. Texts are shuffled once by id; a document sends the one before it only the
    head that one needs, and its signatures.
    """
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).alias("key"), F.xxhash64(whole_text(text)).alias("h"),
        whole_text(text).alias("text"), F.length(whole_text(text)).alias("n"),
    )
    ids = rows.select(F.col("key").try_cast("long").alias("doc_id"), "key", "h", "n")
    # Both readers of ``linked`` use the same four columns of the texts' side, so Spark shuffles it once.
    linked = rows.join(predecessors(ids), ["key", "h"])
    heads = with_signatures(linked.dropDuplicates(["key", "h"]), "text", "next_spots").select(
        F.col("prev.key").alias("key"), F.col("prev.h").alias("h"),
        F.col("text").substr(F.lit(1), F.least(F.floor(F.col("prev.n") / EDIT_SHARE).cast("int"), F.col("n"))).alias("head"), "next_spots",
    )
    cut = F.floor(F.col("n") / EDIT_SHARE).cast("int")
    both = linked.drop("prev").join(heads, ["key", "h"]).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("n") - cut), "head"))
    both = both.select(F.col("key").try_cast("long").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "text", "edited", "next_spots")
    signed = with_signatures(with_signatures(both, "text", "spots"), "edited", "edited_spots")
    return signed.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("spots")).alias("fingerprint"), as_text(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots"), floor).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots"), floor).alias("near_next"),
    )
