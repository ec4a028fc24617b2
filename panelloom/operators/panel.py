"""Building and filtering the long panel: one row per security and calendar month.

Windows by ``id`` run on this panel only, where a security has at most one row per month, so a
window partition is bounded by the calendar. Anything that still has many rows per security
(daily prices, raw duplicates) is reduced by partial aggregation first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as C
from ..functions.scalars import ordinary_share

def by_id():
    """Rows of one security in month order."""
    return Window.partitionBy("id").orderBy("mi")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: str = "last") -> DataFrame:
    """One row per key, chosen by an explicit order. Duplicates are combined before the shuffle."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    rest = [c for c in df.columns if c not in keys]
    by = F.max_by if keep == "last" else F.min_by
    ordering = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return (
        df.groupBy(*keys)
        .agg(by(F.struct(*rest), ordering).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def month_end_close(daily: DataFrame) -> DataFrame:
    """Close of the last trading day of each month and security, dated at calendar month end."""
    return (
        daily.groupBy("id", C.month_index("date").alias("mi"))
        .agg(F.max_by("close", "date").alias("price"), F.max("date").alias("last_trade"))
        .withColumn("date", C.month_end("mi"))
        .select("id", "mi", "date", "last_trade", "price")
    )


def previous(value: str, months: int = 1) -> Column:
    """Value ``months`` calendar months ago; NULL when that month has no row."""
    return F.when(F.lag("mi", months).over(by_id()) == F.col("mi") - months, F.lag(value, months).over(by_id()))


def simple_returns(panel: DataFrame, price: str = "price", ret: str = "ret") -> DataFrame:
    """price / price of the previous calendar month - 1. A gap leaves NULL."""
    return panel.withColumn(ret, F.try_divide(F.col(price), previous(price)) - 1)


def drop_first_month(panel: DataFrame) -> DataFrame:
    """Without the first month of the whole panel, which has no return."""
    first = panel.agg(F.min("mi").alias("mi"))
    return panel.filter(F.col("mi") > first.scalar())


def forward_fill(panel: DataFrame, price: str = "price") -> DataFrame:
    """Carry the last price over the months a security misses, up to the end of the panel.

    Each row is repeated until the next row of its security, so no security x month product is
    built. Only months the panel has are kept, and repeated rows carry ``filled = true``.
    """
    months = panel.select("mi").distinct()
    end = panel.agg(F.max("mi").alias("mi")).scalar()
    priced = panel.filter(F.col(price).isNotNull()).select("id", "mi", price)
    until = F.coalesce(F.lead("mi").over(by_id()) - 1, F.col("_end"))
    return (
        priced.withColumn("_end", end)
        .withColumn("_until", until)
        .withColumn("_mi", F.explode(F.sequence("mi", "_until")))
        .select(
            "id",
            F.col("_mi").alias("mi"),
            C.month_end("_mi").alias("date"),
            price,
            (F.col("_mi") != F.col("mi")).alias("filled"),
        )
        .join(months, "mi", "left_semi")
    )


# ---------------------------------------------------------------- filters


def months_between(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(C.in_period("mi", start, end))


def months_outside(df: DataFrame, periods: Sequence[tuple[str, str]]) -> DataFrame:
    return df.filter(~C.in_any_period("mi", periods))


def common_shares(raw: DataFrame, exchanges: Sequence[str] = K.UNIVERSES["crsp_all"]) -> DataFrame:
    """Ordinary shares on the given exchanges, on the vendor's column names."""
    return raw.filter(ordinary_share() & F.col("PrimaryExch").isin(*exchanges))


def keep_ids(df: DataFrame, ids: DataFrame | Sequence, key: str = "id") -> DataFrame:
    """Rows of the requested securities: a short list, or a table of any size."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).distinct(), key, "left_semi")
    if not ids:
        raise ValueError("no security requested")
    return df.filter(F.col(key).isin(list(ids)))


def missing_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Requested securities the data does not have."""
    return ids.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def integer_ids(ids: DataFrame, key: str = "id") -> DataFrame:
    """Requested ids as numbers; those that are not whole numbers are dropped."""
    number = F.expr(f"try_cast(trim({key}) AS BIGINT)")
    return ids.select(number.alias(key)).filter(F.col(key).isNotNull())


def drop_empty_series(panel: DataFrame, value: str = "price") -> DataFrame:
    """Without securities that never have a value."""
    seen = panel.filter(F.col(value).isNotNull()).select("id").distinct()
    return panel.join(seen, "id", "left_semi")


def complete_months(panel: DataFrame, value: str = "ret") -> DataFrame:
    """Months in which every security of the panel has a value."""
    n_ids = panel.agg(F.countDistinct("id").alias("n")).scalar()
    full = (
        panel.filter(F.col(value).isNotNull())
        .groupBy("mi")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == n_ids)
    )
    return panel.join(full.select("mi"), "mi", "left_semi")


def positive_caps(panel: DataFrame, cap: str = "mcap") -> DataFrame:
    return panel.filter(F.col(cap) > 0)


# ---------------------------------------------------------------- eligibility


def eligibility(panel: DataFrame, lookback: int = K.LOOKBACK_MONTHS, ret: str = "ret") -> DataFrame:
    """(mi, id) with a return in every one of the ``lookback`` months before ``mi``.

    Valid months of a security are distinct and ordered, so the window is complete exactly when
    the row ``lookback - 1`` places earlier is ``lookback - 1`` months earlier.
    """
    months = panel.select("mi").distinct()
    valid = panel.filter(F.col(ret).isNotNull()).select("id", "mi").distinct()
    full = F.lag("mi", lookback - 1).over(by_id()) == F.col("mi") - (lookback - 1)
    return (
        valid.withColumn("_full", full)
        .filter("_full")
        .select((F.col("mi") + 1).alias("mi"), "id")
        .join(months, "mi", "left_semi")
    )


def training_eligibility(panel: DataFrame, lookback: int = K.LOOKBACK_MONTHS, ret: str = "ret", cap: str = "mcap") -> DataFrame:
    """Eligible and with a positive market value in the month before."""
    caps = panel.filter(F.col(cap) > 0).select("id", (F.col("mi") + 1).alias("mi")).distinct()
    return eligibility(panel, lookback, ret).join(caps, ["mi", "id"], "left_semi").select("mi", "id")


def candidates(panel: DataFrame, lookback: int = K.LOOKBACK_MONTHS) -> DataFrame:
    """Everything a sort in month ``mi`` needs, from one pass over each security.

    ``cap_prev`` and ``eligible`` are known at the end of the month before; ``ret`` and ``exch``
    belong to ``mi`` and are NULL when the security has no row then. Needs one row per
    (id, mi); one shuffle by id, or none when the panel is bucketed by id.
    """
    counted = Window.partitionBy("id").orderBy("mi").rangeBetween(-(lookback - 1), 0)
    nxt = F.lead("mi").over(by_id()) == F.col("mi") + 1
    return panel.select(
        "id",
        (F.col("mi") + 1).alias("mi"),
        F.when(F.col("mcap") > 0, F.col("mcap")).alias("cap_prev"),
        (F.count("ret").over(counted) == lookback).alias("eligible"),
        F.when(nxt, F.lead("ret").over(by_id())).alias("ret"),
        F.when(nxt, F.lead("exch").over(by_id())).alias("exch"),
        F.coalesce(nxt, F.lit(False)).alias("listed"),
    )


# ---------------------------------------------------------------- risk-free rate


def align_risk_free(panel: DataFrame, rf: DataFrame) -> DataFrame:
    """Rate of every month of the panel, 0 where the rate table has none."""
    months = panel.select("mi", "date").distinct()
    return months.join(rf.select("mi", "rate"), "mi", "left").select(
        "mi", "date", F.coalesce("rate", F.lit(0.0)).alias("rate")
    )


def excess_returns(panel: DataFrame, rf: DataFrame, ret: str = "ret", on: str = "mi") -> DataFrame:
    """``ret`` minus the rate of its month (or exact date, ``on='date'``); a missing rate is 0."""
    return (
        panel.join(rf.select(on, "rate"), on, "left")
        .withColumn(ret, F.col(ret) - F.coalesce("rate", F.lit(0.0)))
        .drop("rate")
    )


def constant_risk_free(panel: DataFrame, rate: float = 0.0) -> DataFrame:
    return panel.select("mi", "date").distinct().withColumn("rate", F.lit(float(rate)))
