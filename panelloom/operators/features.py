"""Cumulative-return features, cross-sectional targets and sample weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as C
from ..functions.scalars import normal_quantile
from . import crosssection as X
from .panel import by_id, excess_returns

TARGETS = ("ret", "ret_std", "ret_norm", "ret_rank_norm", "ret_pctl")
WEIGHTS = ("ew", "ewpm", "ewpmvw")


def feature_names(lookback: int = K.LOOKBACK_MONTHS) -> list[str]:
    return [f"cr{k}" for k in range(1, lookback + 1)]


def _month_returns(lookback: int, ret: str, anchor: str) -> list[Column]:
    """Return of each of the last ``lookback`` months, newest first; NULL where one is missing.

    A product over the newest months is NULL after any gap, so the row j places back will do. A
    product over the oldest months may skip a gap, so it asks for the month itself.
    """
    if anchor == "trailing":
        at = lambda j: F.when(F.lag("mi", j).over(by_id()) == F.col("mi") - j, F.lag(ret, j).over(by_id()))
    else:
        at = lambda j: F.max(ret).over(by_id().rangeBetween(-j, -j))
    return [at(j) if j else F.col(ret) for j in range(lookback)]


def cumulative_returns(
    panel: DataFrame, lookback: int = K.LOOKBACK_MONTHS, ret: str = "ret", anchor: str = "trailing"
) -> DataFrame:
    """Compounded return over 1..lookback months ending at ``mi``.

    ``anchor='trailing'``: ``crk`` covers the k newest months. ``anchor='oldest'``: the k oldest
    of the lookback. A missing month makes the value NULL. All frames are single rows over one sort
    by id, and the products are plain generated arithmetic.
    """
    if anchor not in ("trailing", "oldest"):
        raise ValueError(f"unknown anchor {anchor!r}")
    monthly = _month_returns(lookback, ret, anchor)
    names = [f"_r{j}" for j in range(lookback)]
    wide = panel.select("id", "mi", *[c.alias(n) for c, n in zip(monthly, names)])
    order = names if anchor == "trailing" else names[::-1]
    growth = [1 + F.col(n) for n in order]
    products = [reduce(lambda a, b: a * b, growth[:k]) - 1 for k in range(1, lookback + 1)]
    return wide.select("id", "mi", *[p.alias(f) for p, f in zip(products, feature_names(lookback))])


def lagged_features(
    panel: DataFrame,
    lookback: int = K.LOOKBACK_MONTHS,
    ret: str = "ret",
    anchor: str = "trailing",
    rf: DataFrame | None = None,
) -> DataFrame:
    """Features known at the end of month ``mi - 1``, for every month with a full lookback.

    They do not look at month ``mi``: a security is scored whether or not it trades then.
    """
    src = panel.select("id", "mi", "date", ret) if rf is not None else panel.select("id", "mi", ret)
    if rf is not None:
        src = excess_returns(src, rf, ret)
    out = cumulative_returns(src, lookback, ret, anchor)
    return out.withColumn("mi", F.col("mi") + 1).filter(F.col(f"cr{lookback}").isNotNull())


def target(returns: DataFrame, kind: str = "ret_norm", ret: str = "ret", out: str = "target") -> DataFrame:
    """Cross-sectional transform of the month's return.

    ret: as is. ret_std: r / std. ret_norm: (r - mean) / std. ret_rank_norm: normal quantile of
    rank / (n + 1). ret_pctl: rank / n. Standard deviations are population ones; 0 counts as 1.
    """
    if kind not in TARGETS:
        raise ValueError(f"unknown target {kind!r}; one of {', '.join(TARGETS)}")
    value = target_value(kind, ret)
    if kind == "ret":
        return returns.withColumn(out, value)
    if kind in ("ret_std", "ret_norm"):
        return X.with_moments(returns, ["mi"], ret, "_mean", "_std").withColumn(out, value).drop("_mean", "_std")
    return X.average_rank(returns, ["mi"], ret, "_rank", "_n").withColumn(out, value).drop("_rank", "_n")


def target_value(kind: str, ret: str = "ret") -> Column:
    """The transform, from the month's ``_mean`` and ``_std`` or the row's ``_rank`` among ``_n``."""
    if kind not in TARGETS:
        raise ValueError(f"unknown target {kind!r}; one of {', '.join(TARGETS)}")
    std = F.when(F.col("_std") == 0, 1.0).otherwise(F.col("_std"))
    return {
        "ret": lambda: F.col(ret),
        "ret_std": lambda: F.col(ret) / std,
        "ret_norm": lambda: (F.col(ret) - F.col("_mean")) / std,
        "ret_rank_norm": lambda: normal_quantile(F.col("_rank") / (F.col("_n") + 1)),
        "ret_pctl": lambda: F.col("_rank") / F.col("_n"),
    }[kind]()


def feature_samples(
    panel: DataFrame,
    kind: str = "ret_norm",
    lookback: int = K.LOOKBACK_MONTHS,
    anchor: str = "trailing",
    rf: DataFrame | None = None,
    eligible: DataFrame | None = None,
    rank_eligible_only: bool = False,
) -> DataFrame:
    """Training samples: features at ``mi - 1``, target and return at ``mi``, cap at ``mi - 1``.

    The target ranks the whole panel of the month and the eligibility filter comes after it,
    unless ``rank_eligible_only``.
    """
    base = panel.select("id", "mi", "date", "ret", "mcap")
    if rf is not None:
        base = excess_returns(base, rf)
    returns = base.filter(F.col("ret").isNotNull()).select("id", "mi", "date", "ret")
    if eligible is not None and rank_eligible_only:
        returns = returns.join(eligible.select("mi", "id"), ["mi", "id"], "left_semi")
    targets = target(returns, kind).withColumnRenamed("ret", "excess_ret")
    feats = lagged_features(base, lookback, anchor=anchor)
    caps = panel.select("id", (F.col("mi") + 1).alias("mi"), F.when(F.col("mcap") > 0, F.col("mcap")).alias("cap_prev"))
    out = (
        feats.join(targets, ["id", "mi"])
        .join(caps, ["id", "mi"], "left")
        .dropna(subset=[*feature_names(lookback), "target"])
    )
    if eligible is not None and not rank_eligible_only:
        out = out.join(eligible.select("mi", "id"), ["mi", "id"], "left_semi")
    return out.select("id", "mi", "date", *feature_names(lookback), "target", "excess_ret", "cap_prev")


def samples_of_targets(panel: DataFrame, kinds: Sequence[str], period: tuple[str, str], lookback: int = K.LOOKBACK_MONTHS) -> DataFrame:
    """Samples of a period as ``feature_samples`` gives them, with a column ``t_<kind>`` for each target.

    Features are derived once and returns ranked once. A target looks only at its own month, so months
    outside the period are left out before the ranks.
    """
    inside = C.in_period("mi", *period)
    out = panel.filter(F.col("ret").isNotNull() & inside).select("id", "mi", "date", "ret")
    if {"ret_std", "ret_norm"} & set(kinds):
        out = X.with_moments(out, ["mi"], "ret", "_mean", "_std")
    if {"ret_rank_norm", "ret_pctl"} & set(kinds):
        out = X.average_rank(out, ["mi"], "ret", "_rank", "_n")
    out = out.select("id", "mi", "date", F.col("ret").alias("excess_ret"), *[target_value(k).alias(f"t_{k}") for k in kinds])
    feats = lagged_features(panel.select("id", "mi", "ret"), lookback).filter(inside)
    caps = panel.select("id", (F.col("mi") + 1).alias("mi"), F.when(F.col("mcap") > 0, F.col("mcap")).alias("cap_prev")).filter(inside)
    names = [*feature_names(lookback), *[f"t_{k}" for k in kinds]]
    out = feats.join(out, ["id", "mi"]).join(caps, ["id", "mi"], "left").dropna(subset=names)
    return out.select("id", "mi", "date", *names, "excess_ret", "cap_prev")


def eligible_samples(samples: DataFrame, eligible: DataFrame) -> DataFrame:
    return samples.join(eligible.select("mi", "id"), ["mi", "id"], "left_semi").select(*samples.columns)


def sample_weights(samples: DataFrame, scheme: str = "ewpm", cap: str = "cap_prev", out: str = "weight") -> DataFrame:
    """Observation weights that sum to 1.

    ew: equal. ewpm: every month equal, equal inside. ewpmvw: every month equal, by market value
    inside; a missing value weighs 0, and a month without any value is weighted equally.
    """
    if scheme not in WEIGHTS:
        raise ValueError(f"unknown weighting {scheme!r}; one of {', '.join(WEIGHTS)}")
    months = samples.groupBy("mi").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(cap).alias("_caps"), F.count(cap).alias("_with_cap")
    )
    everything = Window.partitionBy(F.lit(0))  # the month table has one row per calendar month
    months = X.written(
        months.withColumn("_months", F.count(F.lit(1)).over(everything)).withColumn(
            "_rows", F.sum("_n").over(everything)
        ),
        "weights",
    )
    equal = 1 / F.col("_n")
    by_value = F.when(F.col("_with_cap") > 0, F.coalesce(F.col(cap) / F.col("_caps"), F.lit(0.0))).otherwise(equal)
    weight = {
        "ew": 1 / F.col("_rows"),
        "ewpm": equal / F.col("_months"),
        "ewpmvw": by_value / F.col("_months"),
    }[scheme]
    return samples.join(months, "mi").withColumn(out, weight).select(*samples.columns, out)


def rescaled_weights(samples: DataFrame, weight: str = "weight", is_train: str = "is_train", out: str = "fit_weight") -> DataFrame:
    """Weights of the training rows scaled to mean 1; validation rows keep NULL."""
    stats = samples.filter(F.col(is_train)).agg((F.sum(weight) / F.count(weight)).alias("m"))
    return samples.withColumn(out, F.when(F.col(is_train), F.col(weight) / stats.scalar()))


def month_positions(df: DataFrame) -> DataFrame:
    """Distinct months with their 0-based position and their number. One row per month."""
    every = Window.partitionBy(F.lit(0))
    return df.select("mi").distinct().select(
        "mi",
        (F.row_number().over(every.orderBy("mi")) - 1).alias("pos"),
        F.count(F.lit(1)).over(every).alias("n_months"),
    )


def cv_folds(samples: DataFrame, n_folds: int = 5) -> DataFrame:
    """Months of each expanding-window fold with their role, n_folds - 1 folds in all."""
    if n_folds < 2:
        raise ValueError("at least two folds")
    size = F.floor(F.col("n_months") / n_folds)
    cut = (F.col("fold") + 1) * size
    role = F.when(F.col("pos") < cut, "train").when(
        F.col("pos") < F.least(cut + size, F.col("n_months")), "validate"
    )
    return (
        month_positions(samples)
        .withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(n_folds - 1)])))
        .withColumn("role", role)
        .filter(F.col("role").isNotNull())
        .select("fold", "mi", "role")
    )


def fold_sizes(samples: DataFrame, n_folds: int = 5) -> DataFrame:
    """Training and validation rows of each fold, from month counts (rows are not repeated)."""
    counts = samples.groupBy("mi").agg(F.count(F.lit(1)).alias("n"))
    size = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0))
    return (
        cv_folds(samples, n_folds)
        .join(counts, "mi")
        .groupBy("fold")
        .agg(size("train").alias("train_size"), size("validate").alias("val_size"))
    )


def is_validation(member: int | Column = 0, share: float = K.VALIDATION_SHARE, seed: int = K.SEED, keys: Sequence[str] = ("id", "mi")) -> Column:
    """Whether the row validates the member, by the MD5 of its key and the member's seed."""
    # 32 bits of the digest give a uniform number in [0, 1)
    name = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], (F.lit(seed) + member).cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32) < share


def with_split(
    samples: DataFrame,
    member: int | Column = 0,
    share: float = K.VALIDATION_SHARE,
    seed: int = K.SEED,
    ordered: bool = False,
    keys: Sequence[str] = ("id", "mi"),
) -> DataFrame:
    """``is_validation`` per row.

    Random: the MD5 of the row key and the member's seed, the same on every retry, under any
    partitioning and in any engine; ``member`` may be a column. Ordered: the newest months that make up the share.
    """
    if not ordered:
        return samples.withColumn("is_validation", is_validation(member, share, seed, keys))
    months = samples.groupBy("mi").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("mi")
    cut = months.select(
        "mi",
        (F.sum("n").over(upto) > (1 - share) * F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("is_validation"),
    )
    return samples.join(X.written(cut, "split"), "mi").select(*samples.columns, "is_validation")


def expanding_windows(samples: DataFrame, lookback: int = K.LOOKBACK_MONTHS) -> DataFrame:
    """One row per window end: first and last month and how many samples it covers.

    The samples of a window are ``samples.filter(mi <= window_end)``; nested windows are not
    copied out, their sizes come from running month counts.
    """
    upto = Window.partitionBy(F.lit(0)).orderBy("mi")
    months = samples.groupBy("mi").agg(F.count(F.lit(1)).alias("n"))
    return months.select(
        F.col("mi").alias("window_end"),
        C.month_end("mi").alias("window_date"),
        F.min("mi").over(upto).alias("first_month"),
        F.count(F.lit(1)).over(upto).alias("n_months"),
        F.sum("n").over(upto).alias("n_samples"),
    )


def fitting_flags(samples: DataFrame, start: str, end: str, fitting_months_only: bool = True) -> DataFrame:
    """``in_pool`` (used to fit) and ``in_evaluation`` (held-out months of the same period)."""
    inside = C.in_period("mi", start, end)
    fit = C.is_fitting_month("mi") if fitting_months_only else F.lit(True)
    return samples.withColumn("in_pool", inside & fit).withColumn("in_evaluation", inside & ~fit)
