"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of equal row counts. Its target weight gives block i a release
time and a deadline, the times at which an ideal fluid mix would begin and finish it; time runs
in blocks. One block is then put into every slot, always the one with the earliest deadline
among those released. In every prefix of the mix a source is less than one block away from the
fluid mix. Each row is used exactly once: when a source runs out, the others share its weight
in their proportions, so later windows lie closer together.

Rows of a source are ordered by a hash of their id. The whole table is sorted by (source, hash)
over all tasks, so a source with a third of the rows spans many; a row's number in its source is
its number in its range plus the counts of the ranges before. The schedule holds one row per block:
there are at most ``max_blocks`` plus one per source, which bounds the scheduling task and the
broadcast, and ``max_sources`` sources, beyond which the job stops with an error.

A null source is a source of its own. Missing, null, zero or negative weights are not allowed
for sources that occur. Null ids and repeated rows each take a place of their own. An empty
table gives an empty result. Columns of any name are carried. All steps are Spark's functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.store import written

from .common import fresh

MAX_BLOCKS = 8192
MAX_SOURCES = 4096
#: Weight of a source where none is given: its row count to this power, so large sources are tempered.
TEMPER = 0.7
_EPS = 1e-6


def source_table(counts: DataFrame, weights: DataFrame | None, max_blocks: int, max_sources: int = MAX_SOURCES) -> DataFrame:
    """(key, n) to key, n, rows (of a block), blocks, weight (adding up to 1)."""
    everywhere = Window.partitionBy(F.lit(0))  # one row per source
    rows = F.greatest(F.lit(1), F.ceil(F.sum("n").over(everywhere) / max_blocks)).cast("long")
    if weights is None:
        weighted = counts.withColumn("raw", F.pow(F.col("n").cast("double"), F.lit(TEMPER)))
    else:
        given = weights.select(source_key(F.col("source")).alias("key"), F.col("weight").cast("double").alias("raw"))
        weighted = counts.join(given, "key", "left")
    bad = F.raise_error(F.concat(F.lit("no positive weight for source "), F.col("key")))
    many = F.raise_error(F.lit(f"more than {max_sources} sources"))
    raw = F.when(F.count(F.lit(1)).over(everywhere) > max_sources, many).when(F.coalesce(F.col("raw") > 0, F.lit(False)), F.col("raw")).otherwise(bad)
    return weighted.withColumns({"rows": rows, "raw": raw}).select(
        "key", "n", "rows", F.ceil(F.col("n") / F.col("rows")).cast("int").alias("blocks"),
        (F.col("raw") / F.sum("raw").over(everywhere)).alias("weight"),
    )


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("n:"))


def fluid_time(sources: Column, v: Column) -> Column:
    """Blocks that the fluid mix has done when a source of weight w has done min(its blocks, w * v)."""
    done = lambda acc, s: acc + F.least(s["blocks"].cast("double"), s["weight"] * v)
    return F.aggregate(sources, F.lit(0.0), done)


def schedule(sources: DataFrame) -> DataFrame:
    """Earliest deadline first over all blocks: slot, key, block (from 0), n (rows in the block), start (rows before the slot)."""
    one = sources.groupBy().agg(F.sort_array(F.collect_list(F.struct("key", "blocks", "weight", "n", "rows"))).alias("s")).where(F.size("s") > 0)
    time = lambda i, s: fluid_time(F.col("s"), i / s["weight"])
    windows = F.transform("s", lambda s: F.transform(
        F.sequence(F.lit(1), s["blocks"]),
        lambda i: F.struct(F.floor(time(i - 1, s) + _EPS).alias("release"), F.ceil(time(i, s) - _EPS).alias("deadline")),
    ))
    # The windows are an array column of their own before the fold, so that they are computed once.
    timed = one.select("s", windows.alias("w"), F.aggregate("s", F.lit(0), lambda a, s: a + s["blocks"]).alias("slots"))
    timed = written(timed, "mix-windows")

    def step(state: Column, slot: Column) -> Column:
        def waiting(released: bool) -> Column:
            def of(w: Column, k: Column) -> Column:
                block = F.get(w, F.get(state["done"], k))
                ok = block.isNotNull() & (block["release"] <= slot) if released else block.isNotNull()
                return F.when(ok, F.struct(block["deadline"].alias("deadline"), k.alias("k")))

            return F.array_min(F.transform("w", of))

        # Some released block always waits, since the fluid mix is never idle; the second choice guards rounding.
        pick = F.coalesce(waiting(True), waiting(False))
        return F.struct(
            F.transform(state["done"], lambda n, k: F.when(k == pick["k"], n + 1).otherwise(n)).alias("done"),
            F.array_append(state["order"], pick["k"]).alias("order"),
        )

    start = F.struct(
        F.transform("s", lambda s: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("order")
    )
    order = F.aggregate(F.sequence(F.lit(0), F.col("slots") - 1), start, step, lambda x: x["order"])
    slots = timed.select("s", order.alias("order")).select("s", F.posexplode("order").alias("slot", "k"))
    slots = slots.select("slot", F.get(F.col("s"), F.col("k")).alias("s"))
    block = F.row_number().over(Window.partitionBy("s.key").orderBy("slot")) - 1
    sized = slots.withColumn("block", block.cast("long")).select(
        F.col("slot").cast("long").alias("slot"), "s.key", "block", F.least(F.col("s.rows"), F.col("s.n") - F.col("block") * F.col("s.rows")).alias("n"), "s.rows"
    )
    before = Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", doc_id: str = "doc_id",
        max_blocks: int = MAX_BLOCKS, out: tuple[str, str] = ("slot", "position")) -> DataFrame:
    """``docs`` with the slot of each row's block and the row's position in the mix (from 0, gapless).

    ``weights``: (source, weight); by default row counts to the power ``TEMPER``.
    """
    spark = docs.sparkSession
    key, h, tie, row, block = fresh(docs, "key", "hash", "tie", "row", "block")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumns({
        key: source_key(F.col(source)),
        h: F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")),
        tie: F.monotonically_increasing_id(),
    })
    by = [key, h, tie]
    ranged = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(h, tie)
    # Partition number and row number in the partition, fixed by writing them down.
    ranged = written(ranged.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    part = F.shiftrightunsigned(F.col(row), 33)
    ranges = ranged.groupBy(F.col(key).alias("key"), part.alias("part")).agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n"))
    ranges = written(ranges, "mix-ranges")
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    table = source_table(ranges.groupBy("key").agg(F.sum("n").alias("n")), weights, max_blocks)
    plan = written(schedule(table), "mix-schedule")
    shift, part_, k2, start, rows = fresh(ranged, "shift", "part", "skey", "start", "rows")
    offsets = offsets.select(F.col("key").alias(k2), F.col("part").alias(part_), F.col("shift").alias(shift))
    sizes = plan.groupBy("key").agg(F.max("rows").alias(rows))
    offsets = offsets.join(sizes.withColumnRenamed("key", k2), k2)
    offsets = offsets.withColumnsRenamed({k2: key})
    placed = ranged.withColumn(part_, part).join(F.broadcast(offsets), [key, part_])
    rank = F.col(row) + F.col(shift)
    placed = placed.withColumn(block, F.floor(rank / F.col(rows))).withColumn(row, rank % F.col(rows))
    slot_ = fresh(placed, "slot")[0]
    plan = plan.select(F.col("key").alias(key), F.col("block").alias(block), F.col("slot").alias(slot_), F.col("start").alias(start))
    done = placed.join(F.broadcast(plan), [key, block])
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in out]
    return done.select(*keep, F.col(slot_).alias(out[0]), (F.col(start) + F.col(row)).alias(out[1]))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the order of the mix: sorted over all partitions, columns unchanged."""
    slot, position = fresh(docs, "slot", "position")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        mix(docs, out=(slot, position), **options).repartitionByRange(parts, position).sortWithinPartitions(position).drop(slot, position)
    )
