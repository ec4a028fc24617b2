"""Several models side by side: similarity, shared holdings, sub-period tables.

``fits`` is a list of (model, train_start, train_end). Months inside a model's own training
period are removed from that model first; a pair then uses the months both have left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as C
from .crosssection import correlation
from .evaluate import rank_correlation
from .panel import keep_one
from .performance import performance
from .sorts import LONG_SHORT, clean_scores

Fits = Sequence[tuple[str, str, str]]


def windows_table(df: DataFrame, windows: Sequence[tuple[str, str, str]] = K.EXPANDING_WINDOWS) -> DataFrame:
    """Expanding windows as rows: (window, train_end, lo, hi) with month indexes."""
    rows = [
        (f"window_{end.replace('-', '')}", C.period_index(end), C.period_index(a), C.period_index(b))
        for end, a, b in windows
    ]
    return df.sparkSession.createDataFrame(rows, "window string, train_end int, lo int, hi int")


def assign_window(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Window whose forecast months contain ``mi``. The window table is a handful of rows."""
    return df.join(F.broadcast(windows), F.col("mi").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def outside_training(df: DataFrame, fits: Fits) -> DataFrame:
    """Rows whose month is not in the training period of their model."""
    rows = [(m, C.period_index(a), C.period_index(b)) for m, a, b in fits]
    t = df.sparkSession.createDataFrame(rows, "_m string, _lo int, _hi int")
    inside = (F.col("model") == F.col("_m")) & F.col("mi").between(F.col("_lo"), F.col("_hi"))
    return df.join(F.broadcast(t), inside, "left_anti")


def merge_forecasts(parts: Sequence[DataFrame]) -> DataFrame:
    """Forecasts of several windows in one table; an earlier part wins a shared (mi, id)."""
    tagged = [clean_scores(p).withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return keep_one(out, ["mi", "id"], ["_part"], keep="first").drop("_part")


def _pairs(models: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(models)) for j in range(i + 1, len(models))]


def _side_by_side(df: DataFrame, keys: Sequence[str], models: Sequence[str], value: str) -> DataFrame:
    """One column per model (m0, m1, ...). The models are a short list."""
    at = lambda m: F.max(F.when(F.col("model") == m, F.col(value)))
    return df.groupBy(*keys).agg(*[at(m).alias(f"m{i}") for i, m in enumerate(models)])


def _pair_rows(wide: DataFrame, models: Sequence[str], cell) -> DataFrame:
    return wide.select(F.inline(F.array(*[cell(i, j) for i, j in _pairs(models)])))


def _labels(models, i, j) -> list[Column]:
    return [F.lit(models[i]).alias("model_a"), F.lit(models[j]).alias("model_b")]


def forecast_similarity(
    scores: DataFrame,
    models: Sequence[str],
    fits: Fits = (),
    period: tuple[str, str] | None = None,
    min_names: int = K.MIN_NAMES,
) -> DataFrame:
    """Mean monthly rank correlation of the forecasts of each pair of models."""
    s = clean_scores(scores)
    if period:
        s = s.filter(C.in_period("mi", *period))
    if fits:
        s = outside_training(s, fits)
    wide = _side_by_side(s, ["mi", "id"], models, "score")
    rows = wide.select(
        "mi",
        F.inline(
            F.array(
                *[F.struct(*_labels(models, i, j), F.col(f"m{i}").alias("x"), F.col(f"m{j}").alias("y")) for i, j in _pairs(models)]
            )
        ),
    )
    monthly = rank_correlation(rows, ["model_a", "model_b", "mi"], "x", "y", min_names)
    return (
        monthly.filter(F.col("correlation").isNotNull())
        .groupBy("model_a", "model_b")
        .agg(F.avg("correlation").alias("forecast_correlation"), F.count(F.lit(1)).alias("n_months"))
    )


def common_holdings(holdings: DataFrame, models: Sequence[str], fits: Fits = ()) -> DataFrame:
    """Mean share of names two models hold on the same side.

    Per month and pair: names in the same leg over the mean number of names of both. All pairs
    are counted in one aggregation by month.
    """
    h = outside_training(holdings, fits) if fits else holdings
    wide = _side_by_side(h, ["mi", "id"], models, "leg")
    counts = wide.groupBy("mi").agg(
        *[F.count(f"m{i}").alias(f"n{i}") for i in range(len(models))],
        *[F.count(F.when(F.col(f"m{i}") == F.col(f"m{j}"), 1)).alias(f"s{i}_{j}") for i, j in _pairs(models)],
    )

    def cell(i: int, j: int) -> Column:
        both = (F.col(f"n{i}") > 0) & (F.col(f"n{j}") > 0)
        share = F.col(f"s{i}_{j}") / ((F.col(f"n{i}") + F.col(f"n{j}")) / 2)
        return F.struct(*_labels(models, i, j), F.when(both, share).alias("share"))

    return (
        _pair_rows(counts, models, cell)
        .filter(F.col("share").isNotNull())
        .groupBy("model_a", "model_b")
        .agg(F.avg("share").alias("common_holdings"), F.count(F.lit(1)).alias("n_months"))
    )


def return_similarity(series: DataFrame, models: Sequence[str], fits: Fits = (), min_months: int = 3) -> DataFrame:
    """Correlation of the long-short returns of each pair of models."""
    ls = series.filter((F.col("portfolio") == LONG_SHORT) & F.col("ret").isNotNull())
    if fits:
        ls = outside_training(ls, fits)
    wide = _side_by_side(ls, ["mi"], models, "ret")

    def cell(i: int, j: int) -> Column:
        return F.struct(*_labels(models, i, j), F.col(f"m{i}").alias("x"), F.col(f"m{j}").alias("y"))

    return (
        _pair_rows(wide, models, cell)
        .dropna(subset=["x", "y"])
        .groupBy("model_a", "model_b")
        .agg(correlation("x", "y").alias("return_correlation"), F.count(F.lit(1)).alias("n_months"))
        .filter(F.col("n_months") >= min_months)
    )


def pair_matrix(pairs: DataFrame, models: Sequence[str], value: str) -> DataFrame:
    """Symmetric display matrix with ones on the diagonal."""
    mirrored = pairs.select(F.col("model_a").alias("row"), F.col("model_b").alias("other"), value).unionByName(
        pairs.select(F.col("model_b").alias("row"), F.col("model_a").alias("other"), value)
    )
    diagonal = pairs.sparkSession.createDataFrame([(m, m, 1.0) for m in models], f"row string, other string, {value} double")
    return mirrored.unionByName(diagonal).groupBy("row").pivot("other", list(models)).agg(F.first(value))


def subperiod_returns(
    series: DataFrame,
    periods: Sequence[tuple[str, str, str]] = K.RETURN_SUBPERIODS,
    fits: Fits = (),
    lags: int = K.NEWEY_WEST_LAGS,
) -> DataFrame:
    """Mean (in percent) and t of every model's long-short return in each period, long form."""
    ls = series.filter(F.col("portfolio") == LONG_SHORT)
    if fits:
        ls = outside_training(ls, fits)
    label = F.lit(None).cast("string")
    for name, start, end in periods:
        label = F.when(C.in_period("mi", start, end), F.lit(name)).otherwise(label)
    rows = ls.withColumn("return_period", label).filter(F.col("return_period").isNotNull())
    perf = performance(rows, ["return_period", "model"], lags)
    return perf.select(
        "return_period", "model", (F.col("mean_return") * 100).alias("mean_pct"), F.col("t_statistic").alias("t"), "n_months"
    )


def subperiod_matrix(table: DataFrame, models: Sequence[str]) -> DataFrame:
    """Rows: return periods. Columns: ``{model}_mean_pct`` and ``{model}_t``."""
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    cols = []
    for m in models:
        cols += [pick(m, "mean_pct").alias(f"{m}_mean_pct"), pick(m, "t").alias(f"{m}_t")]
    return table.groupBy("return_period").agg(*cols)


def compare_models(perf: DataFrame) -> DataFrame:
    """One row per model: the core numbers of its long-short portfolio."""
    return perf.filter(F.col("portfolio") == LONG_SHORT).select(
        "model", "mean_return", "std_dev", "sharpe_ratio", "t_statistic"
    )
