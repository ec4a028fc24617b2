"""Statistics of a group (usually a month) brought back to its rows.

A group can be arbitrarily large, so nothing here relies on a group fitting one task. Moments
use partial aggregation. Ranks and quantiles of groups of any size use exact running counts over
range-partitioned chunks, which spread one group over many tasks. Inputs should be written data,
since they are read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

SALTS = 64


def salt_of(*keys: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(salts))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of the rows that have both; NULL when a side does not vary.

    The built-in one raises on a constant side under ANSI arithmetic.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def group_table(df: DataFrame, by: Sequence[str], label: str, **aggregates: Column) -> DataFrame:
    """One row per group, written, so that a later join sees its true size."""
    return written(df.groupBy(*by).agg(*[c.alias(k) for k, c in aggregates.items()]), label)


def with_moments(df: DataFrame, by: Sequence[str], value: str, mean="mean", std="std") -> DataFrame:
    """Mean and population standard deviation of the group on every row."""
    m = group_table(df, by, "moments", **{mean: F.avg(value), std: F.stddev_pop(value)})
    return df.join(m, list(by), "left")


# ---------------------------------------------------------------- ranks


def _chunks(counts: DataFrame, by: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Counted values in value order, cut into chunks of about equal size, and chunk totals.

    ``counts`` has one row (or one per salt) for each group and value, with its count ``_c``.
    Range partitioning balances the chunks whatever the distribution, and keeps equal values
    together. The chunk number is written with the rows, so every later stage and every retry
    sees the same cut. The totals have at most one row per group and chunk.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        counts.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()), "chunks"
    )
    group = Window.partitionBy(*by)
    lower = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_part").agg(F.sum("_c").alias("_in"))
    offsets = totals.select(
        *by,
        "_part",
        "_in",
        F.coalesce(F.sum("_in").over(lower), F.lit(0)).alias("_before"),
        F.sum("_in").over(group).alias("_total"),
    )
    return placed, offsets


def average_rank(df: DataFrame, by: Sequence[str], value: str, rank: str = "rank", n: str = "n", salts: int = SALTS) -> DataFrame:
    """Rank from 1, ties share the mean rank, and the group size. NULL values are dropped.

    Distinct values are counted first, with a salt, so that a value that fills a third of the
    rows is counted and joined back by many tasks. The counts are then accumulated inside each
    chunk, and the chunks per group. The salt is a hash of the whole row: keep a column that
    tells equal values apart, such as an id.
    """
    keyed = df.filter(F.col(value).isNotNull()).withColumn("_salt", salt_of(*df.columns, salts=salts))
    counts = keyed.groupBy(*by, value, "_salt").agg(F.count(F.lit(1)).alias("_c"))
    placed, offsets = _chunks(counts, by, value)
    chunk = Window.partitionBy(*by, "_part")
    ranks = (
        placed.join(offsets, [*by, "_part"])
        .withColumn("_upto", F.sum("_c").over(chunk.orderBy(value)))
        .withColumn("_equal", F.sum("_c").over(Window.partitionBy(*by, "_part", value)))
        .select(
            *by,
            value,
            "_salt",
            (F.col("_before") + F.col("_upto") - (F.col("_equal") - 1) / 2).alias(rank),
            F.col("_total").alias(n),
        )
    )
    return keyed.join(ranks, [*by, value, "_salt"]).select(*df.columns, rank, n)


# ---------------------------------------------------------------- quantiles


def _quantiles_by_chunks(df, by, value, fractions, outside=None):
    """Exact order statistics: count the values per chunk, then look only inside the chunks hit.

    ``outside`` (by, _below, _all): rows of the group below those of ``df``, and all of its rows.
    """
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed, offsets = _chunks(counts, by, "_v")
    if outside is not None:
        offsets = offsets.join(outside, list(by)).withColumns({"_before": F.col("_before") + F.col("_below"), "_total": F.col("_all")}).drop("_below", "_all")

    # every fraction needs the order statistics just below and just above its position
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("f")) for i, f in enumerate(fractions)])
    last = F.col("_total") - 1
    targets = F.flatten(
        F.transform(
            wanted,
            lambda s: F.array(
                F.struct(s["i"].alias("i"), F.lit(0).alias("side"), F.floor(s["f"] * last).alias("pos")),
                F.struct(s["i"].alias("i"), F.lit(1).alias("side"), F.ceil(s["f"] * last).alias("pos")),
            ),
        )
    )
    inside = lambda t, lo, hi: (t["pos"] >= lo) & (t["pos"] < hi)
    needed = offsets.withColumn(
        "_hit", F.filter(targets, lambda t: inside(t, F.col("_before"), F.col("_before") + F.col("_in")))
    ).filter(F.size("_hit") > 0)
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    picked = (
        placed.join(needed, [*by, "_part"])
        .withColumn("_upto", upto)
        .withColumn("_t", F.explode(F.filter("_hit", lambda t: inside(t, F.col("_upto") - F.col("_c"), F.col("_upto")))))
    )
    at = F.element_at(F.array(*[F.lit(float(f)) for f in fractions]), F.col("_t.i") + 1) * last
    per_fraction = picked.groupBy(*by, F.col("_t.i").alias("_i")).agg(
        F.max(F.when(F.col("_t.side") == 0, F.col("_v"))).alias("_low"),
        F.max(F.when(F.col("_t.side") == 1, F.col("_v"))).alias("_high"),
        F.max(at - F.floor(at)).alias("_w"),
        F.max("_total").alias("_total"),
    )
    value_at = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_w")
    return per_fraction.groupBy(*by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), value_at.alias("v")))), lambda s: s["v"]
        ).alias("breakpoints"),
        F.max("_total").alias("n_values"),
    )


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float], values: str = "n_values", rows: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per group as the array ``breakpoints``.

    Also the number of values, and on request the number of rows (missing values included; a
    group without any value then keeps its row). ``df`` should be written data.
    """
    src = df.select(*by, value)
    out = _quantiles_by_chunks(src.filter(F.col(value).isNotNull()), by, value, fractions)
    keep = [*by, "breakpoints", F.col("n_values").alias(values)]
    if not rows:
        return out.select(*keep)
    counts = src.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    out = counts.join(out, list(by), "left").withColumn("n_values", F.coalesce("n_values", F.lit(0)))
    return out.select(*keep, F.col("n_rows").alias(rows))


#: Share of a group's values, on either side, in which a median is looked for.
MEDIAN_BRACKET = 0.01


def medians(df: DataFrame, by: Sequence[str], columns: Sequence[str], bracket: float = MEDIAN_BRACKET) -> DataFrame:
    """(by, _column, breakpoints, n_values): exact medians of many columns, one row per group and column.

    A quantile summary of bounded size gives two values around each median. The values below are counted
    and only those between are ordered; where a count shows that the median lies elsewhere, all
    values of that group and column are. ``df`` should be written data with few groups.
    """
    around = [F.percentile_approx(F.col(c).cast("double"), [0.5 - bracket, 0.5 + bracket], F.lit(int(4 / bracket))).alias(f"_b{i}") for i, c in enumerate(columns)]
    bounds = written(df.groupBy(*by).agg(*around), "brackets")
    rows = df.select(*by, *columns).join(bounds, list(by))
    v = [F.col(c).cast("double") for c in columns]
    lo, hi = ([F.get(F.col(f"_b{i}"), F.lit(k)) for i in range(len(columns))] for k in (0, 1))
    within = [(x >= a) & (x <= b) for x, a, b in zip(v, lo, hi)]
    counts = rows.groupBy(*by).agg(*[
        F.struct(F.lit(c).alias("_column"), F.count(F.when(x < a, 1)).alias("_below"), F.count(F.when(w, 1)).alias("_in"), F.count(x).alias("_all")).alias(f"_n{i}")
        for i, (c, x, a, w) in enumerate(zip(columns, v, lo, within))
    ])
    counts = counts.select(*by, F.inline(F.array(*[F.col(f"_n{i}") for i in range(len(columns))]))).filter(F.col("_all") > 0)
    last = F.col("_all") - 1
    found = (F.floor(last / 2) >= F.col("_below")) & (F.ceil(last / 2) < F.col("_below") + F.col("_in"))
    counts = written(counts.withColumn("_found", found), "bracket-counts")
    keys = [*by, "_column"]

    def values(keep: list[Column]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("_column"), x.alias("_v"), k.alias("_k")) for c, x, k in zip(columns, v, keep)])
        return rows.select(*by, F.inline(F.filter(cells, lambda s: s["_k"]))).drop("_k")

    out = _quantiles_by_chunks(values(within).join(counts.filter("_found").select(*keys), keys), keys, "_v", [0.5], counts.select(*keys, "_below", "_all"))
    missed = counts.filter("NOT _found").select(*keys)
    if missed.isEmpty():
        return out
    return out.unionByName(_quantiles_by_chunks(values([x.isNotNull() for x in v]).join(missed, keys), keys, "_v", [0.5]))


def breakpoints(df, by, value, n_parts: int, **names) -> DataFrame:
    return quantiles(df, by, value, [k / n_parts for k in range(1, n_parts)], **names)


def quantile_of(value: Column | str, bps: Column | str) -> Column:
    """1 + number of breakpoints below the value; a value on a breakpoint stays below it."""
    v = F.col(value) if isinstance(value, str) else value
    b = F.col(bps) if isinstance(bps, str) else bps
    return F.size(F.filter(b, lambda x: v > x)) + 1


# ---------------------------------------------------------------- largest n


def top_n(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    n: int,
    key: str = "id",
    position: str = "rn",
    salts: int = SALTS,
) -> DataFrame:
    """First ``n`` rows of each group with their position.

    Two steps: the best ``n`` of every salted part of the group, then the best ``n`` of those,
    so the last step sees at most ``salts * n`` rows of a group.
    """
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    best = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_salt", salt_of(key, salts=salts))
        .withColumn("_rn", F.row_number().over(part))
        .filter(F.col("_rn") <= n)
        .drop("_rn", "_salt")
        .withColumn(position, F.row_number().over(best))
        .filter(F.col(position) <= n)
    )
