"""Performance and risk of portfolio return series.

Input: ``portfolio_returns(model, portfolio, mi, ret)``. A series has one row per month, so
windows by (model, portfolio) are bounded by the calendar. Missing months are left out of the
statistics, and lags run over the months that remain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as C
from ..functions.scalars import normal_quantile
from .crosssection import correlation
from .store import written

SERIES = ("model", "portfolio")
ROOT12 = 12.0**0.5


def _windows(keys: Sequence[str]):
    w = Window.partitionBy(*keys)
    return w, w.orderBy("mi"), w.orderBy("mi").rowsBetween(Window.unboundedPreceding, 0)


def equity_curve(series: DataFrame, keys: Sequence[str] = SERIES, initial: float = 1.0, start_row: bool = False) -> DataFrame:
    """Compounded value, missing returns as 0; ``start_row`` adds the opening value (period 0)."""
    _, ordered, upto = _windows(keys)
    curve = series.select(
        *keys,
        F.row_number().over(ordered).alias("period"),
        "mi",
        (F.lit(float(initial)) * F.product(1 + F.coalesce("ret", F.lit(0.0))).over(upto)).alias("value"),
    )
    if start_row:
        opening = series.select(*keys).distinct().select(
            *keys, F.lit(0).alias("period"), F.lit(None).cast("int").alias("mi"), F.lit(float(initial)).alias("value")
        )
        curve = opening.unionByName(curve)
    return curve


def drawdowns(series: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Distance below the running maximum; the first value is its own maximum."""
    _, _, upto = _windows(keys)
    peak = F.max("value").over(upto)
    return equity_curve(series, keys).select(*keys, "mi", "value", F.try_divide(F.col("value") - peak, peak).alias("drawdown"))


def _prepared(series: DataFrame, keys: Sequence[str], lags: int) -> DataFrame:
    """Non-missing returns with drawdown, deviation from the mean, and its lagged products."""
    whole, ordered, upto = _windows(keys)
    curve = (
        series.filter(F.col("ret").isNotNull())
        .select(*keys, "mi", "ret")
        .withColumn("_cum", F.product(1 + F.col("ret")).over(upto))
        .withColumn("_d", F.col("ret") - F.avg("ret").over(whole))
    )
    peak = F.max("_cum").over(upto)
    lagged = [(F.col("_d") * F.lag("_d", l).over(ordered)).alias(f"_g{l}") for l in range(1, lags + 1)]
    return curve.select(*keys, "mi", "ret", "_d", F.try_divide(F.col("_cum") - peak, peak).alias("_dd"), *lagged)


def _newey_west_variance(n: Column, lags: int) -> Column:
    out = F.sum(F.col("_d") * F.col("_d")) / n
    for l in range(1, lags + 1):
        out = out + 2 * (1 - l / (lags + 1)) * F.coalesce(F.sum(f"_g{l}"), F.lit(0.0)) / n
    return out


def _t_stat(lags: int) -> Column:
    n = F.count(F.lit(1))
    mean = F.avg("ret")
    long_var = _newey_west_variance(n, lags) / n
    short_se = F.stddev_pop("ret") / F.sqrt(n)
    long_se = F.sqrt(F.when(long_var > 0, long_var))
    return F.try_divide(mean, F.when(n < lags + 2, F.when(short_se > 0, short_se)).otherwise(long_se))


def performance(series: DataFrame, keys: Sequence[str] = SERIES, lags: int = K.NEWEY_WEST_LAGS) -> DataFrame:
    """Mean, std, Sharpe, Newey-West t, CAGR, maximum drawdown and months of every series.

    A series without any return keeps its row with 0 months.
    """
    n = F.count(F.lit(1))
    std = F.stddev_pop("ret")
    growth = F.product(1 + F.col("ret"))  # below zero there is no yearly rate
    stats = _prepared(series, keys, lags).groupBy(*keys).agg(
        F.avg("ret").alias("mean_return"),
        std.alias("std_dev"),
        F.when(std > 0, F.avg("ret") / std * ROOT12).otherwise(0.0).alias("sharpe_ratio"),
        _t_stat(lags).alias("t_statistic"),
        (F.pow(F.when(growth >= 0, growth), 12 / n) - 1).alias("annualized_return"),
        F.min("_dd").alias("max_drawdown"),
        n.alias("n_months"),
    )
    return (
        series.select(*keys).distinct().join(stats, list(keys), "left")
        .withColumn("n_months", F.coalesce("n_months", F.lit(0)).cast("long"))
    )


def newey_west(series: DataFrame, keys: Sequence[str] = SERIES, lags: int = K.NEWEY_WEST_LAGS) -> DataFrame:
    """Newey-West standard error of the mean and t statistic."""
    n = F.count(F.lit(1))
    var = _newey_west_variance(n, lags) / n
    return _prepared(series, keys, lags).groupBy(*keys).agg(
        F.sqrt(F.when(var >= 0, var)).alias("nw_se"), _t_stat(lags).alias("t_statistic"), n.alias("n_months")
    )


def extended_metrics(series: DataFrame, keys: Sequence[str] = SERIES, rf: float = 0.0, periods: int = 12) -> DataFrame:
    """Shape, downside and annualised statistics. Ratios with a zero denominator are NULL.

    Annualised return here is ``(1 + mean) ** periods - 1``; the core table has the CAGR.
    """
    root = float(periods) ** 0.5
    excess = F.col("ret") - F.lit(float(rf))
    std = F.stddev_pop("ret")
    down = F.stddev_pop(F.when(excess < 0, excess))
    annual = F.pow(1 + F.avg("ret"), periods) - 1
    worst = F.abs(F.min("_dd"))
    return _prepared(series, keys, 0).groupBy(*keys).agg(
        F.avg("ret").alias("mean_return"),
        std.alias("std_dev"),
        F.skewness("ret").alias("skewness"),
        F.kurtosis("ret").alias("kurtosis"),
        F.when(F.stddev_pop(excess) > 0, F.avg(excess) / F.stddev_pop(excess) * root).otherwise(0.0).alias("sharpe_ratio"),
        F.try_divide(F.avg(excess), F.when(down > 0, down)).__mul__(root).alias("sortino_ratio"),
        F.min("_dd").alias("max_drawdown"),
        F.try_divide(annual, F.when(worst > 0, worst)).alias("calmar_ratio"),
        F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("positive_months_pct"),
        F.max("ret").alias("best_month"),
        F.min("ret").alias("worst_month"),
        annual.alias("annualized_return"),
        (std * root).alias("annualized_std"),
    )


def net_of_costs(series: DataFrame, cost: float = K.TRADING_COST, turnover: float = K.ASSUMED_TURNOVER) -> DataFrame:
    """Returns after trading cost at a fixed turnover; both legs pay in a long-short series."""
    legs = F.when(F.col("portfolio") == "long_short", 2.0).otherwise(1.0)
    return series.withColumn("ret", F.col("ret") - legs * float(turnover * cost))


def backtest(series: DataFrame, cost: float = K.TRADING_COST, include_costs: bool = True) -> DataFrame:
    """Compounded value of every portfolio, net of costs."""
    return equity_curve(net_of_costs(series, cost) if include_costs else series)


def cumulative_wide(series: DataFrame, portfolios: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """Value of each portfolio as a column, one row per model and month."""
    return equity_curve(series, keys).groupBy("model", "mi").pivot("portfolio", list(portfolios)).agg(F.first("value"))


def rolling_stats(series: DataFrame, keys: Sequence[str] = SERIES, window: int = K.ROLLING_MONTHS, skip_missing: bool = True) -> DataFrame:
    """Mean, population std and Sharpe of the last ``window`` rows, NULL until they exist.

    ``skip_missing``: missing returns inside the window are ignored and a zero std gives
    Sharpe 0. Otherwise one missing return makes the window NULL, as does a zero std the Sharpe.
    """
    _, ordered, _ = _windows(keys)
    last = ordered.rowsBetween(-(window - 1), 0)
    full = F.row_number().over(ordered) >= window
    ok = full if skip_missing else full & (F.count("ret").over(last) == window)
    mean, std = F.avg("ret").over(last), F.stddev_pop("ret").over(last)
    sharpe = F.when(std > 0, mean / std * ROOT12)
    if skip_missing:
        sharpe = F.when(std == 0, 0.0).otherwise(sharpe)
    return series.select(
        *keys, "mi", F.when(ok, mean).alias("rolling_mean"), F.when(ok, std).alias("rolling_std"),
        F.when(ok, sharpe).alias("rolling_sharpe"),
    )


# ---------------------------------------------------------------- tail risk and co-movement


def value_at_risk(series: DataFrame, keys: Sequence[str] = SERIES, confidence: float = K.CONFIDENCE) -> DataFrame:
    """Historical and parametric value at risk, and the mean of returns not above the former."""
    tail = round(1 - confidence, 12)
    whole = Window.partitionBy(*keys)
    cut = F.percentile("ret", F.lit(tail)).over(whole)
    rows = series.filter(F.col("ret").isNotNull()).select(*keys, "ret", cut.alias("_var"))
    z = normal_quantile(F.lit(tail))
    return rows.groupBy(*keys).agg(
        F.max("_var").alias("var_historical"),
        (F.avg("ret") + F.stddev_pop("ret") * z).alias("var_parametric"),
        F.avg(F.when(F.col("ret") <= F.col("_var"), F.col("ret"))).alias("cvar"),
    )


def _against(series: DataFrame, benchmark: DataFrame) -> DataFrame:
    b = benchmark.select("mi", F.col("ret").alias("_b"))
    return series.filter(F.col("ret").isNotNull()).join(b.filter(F.col("_b").isNotNull()), "mi")


def beta(series: DataFrame, market: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Sample covariance over population variance on common months; 0 if degenerate."""
    v = F.var_pop("_b")
    b = F.coalesce(F.when(v > 0, F.covar_samp("ret", "_b") / v), F.lit(0.0))
    stats = _against(series, market).groupBy(*keys).agg(b.alias("beta"))
    return series.select(*keys).distinct().join(stats, list(keys), "left").select(
        *keys, F.coalesce("beta", F.lit(0.0)).alias("beta")
    )


def information_ratio(series: DataFrame, benchmark: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Annualised mean over std of the return in excess of the benchmark; 0 if degenerate."""
    active = F.col("ret") - F.col("_b")
    ir = F.when(F.stddev_pop(active) > 0, F.avg(active) / F.stddev_pop(active) * ROOT12).otherwise(0.0)
    stats = _against(series, benchmark).groupBy(*keys).agg(ir.alias("information_ratio"))
    return series.select(*keys).distinct().join(stats, list(keys), "left").select(
        *keys, F.coalesce("information_ratio", F.lit(0.0)).alias("information_ratio")
    )


def correlation_matrix(series: DataFrame, portfolios: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations in long form: (model, portfolio, other, correlation).

    The listed portfolios of a month become one row, and all pairs are aggregated at once.
    """
    names = list(portfolios)
    at = lambda p: F.max(F.when(F.col("portfolio") == p, F.col("ret")))
    wide = series.groupBy("model", "mi").agg(*[at(p).alias(f"_{i}") for i, p in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    corr = wide.groupBy("model").agg(*[correlation(f"_{i}", f"_{j}").alias(f"c{i}_{j}") for i, j in pairs])
    cells = []
    for i, j in pairs:
        for a, b in {(i, j), (j, i)}:
            cells.append(
                F.struct(F.lit(names[a]).alias("portfolio"), F.lit(names[b]).alias("other"), F.col(f"c{i}_{j}").alias("correlation"))
            )
    return corr.select("model", F.inline(F.array(*cells)))


# ---------------------------------------------------------------- tables


def summary_table(perf: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return perf.select(
        *keys,
        (F.col("mean_return") * 100).alias("mean_pct"),
        (F.col("std_dev") * 100).alias("std_pct"),
        F.col("sharpe_ratio").alias("sharpe"),
        F.col("t_statistic").alias("t_stat"),
    )


def metrics_by_portfolio(perf: DataFrame, portfolios: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per model and metric, one column per portfolio."""
    long = perf.unpivot(["model", "portfolio"], list(metrics), "metric", "value")
    return long.groupBy("model", "metric").pivot("portfolio", list(portfolios)).agg(F.first("value"))


def calendar_grid(series: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """One row per year, one column per month (m1 .. m12)."""
    cell = lambda m: F.max(F.when(C.month_of("mi") == m, F.col("ret"))).alias(f"m{m}")
    return series.groupBy(*keys, C.year_of("mi").alias("year")).agg(*[cell(m) for m in range(1, 13)])


def subperiod_performance(series: DataFrame, periods: Sequence[tuple[str, str, str]], keys: Sequence[str] = SERIES, lags: int = K.NEWEY_WEST_LAGS) -> DataFrame:
    """The core table inside each named period."""
    label = F.lit(None).cast("string")
    for name, start, end in reversed(list(periods)):
        label = F.when(C.in_period("mi", start, end), F.lit(name)).otherwise(label)
    cut = series.withColumn("period", label).filter(F.col("period").isNotNull())
    return performance(cut, [*keys, "period"], lags)


def best_model(table: DataFrame, score: str, config: str = "model") -> DataFrame:
    return table.agg(F.max_by(config, score).alias(config), F.max(score).alias(score))


def market_return(panel: DataFrame, cap: str = "cap_prev") -> DataFrame:
    """Value-weighted return of everything listed, per month."""
    from .sorts import value_weighted_return

    return written(panel.groupBy("mi").agg(value_weighted_return(cap=cap).alias("ret")).filter(F.col("ret").isNotNull()), "market")
