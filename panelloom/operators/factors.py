"""Factor exposures of portfolio return series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from . import crosssection as X
from .moments import reduced
from .performance import SERIES
from .store import written


def characteristic_spreads(pool: DataFrame, characteristics: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Factor returns: value-weighted difference of the two halves of each characteristic, per month.

    ``characteristics`` maps a factor name to a column of ``pool`` (mi, ret, cap_prev, ...) and a
    sign: 1 for the upper minus the lower half, -1 for the lower minus the upper half (small minus
    big, losers minus winners). Medians are exact, and only the values near them are ordered.
    """
    columns = sorted({c for c, _ in characteristics.values()})
    pool = written(pool.filter(F.col("ret").isNotNull()).select("mi", "ret", *{"cap_prev", *columns}), "factor_pool")
    medians = X.medians(pool, ["mi"], columns).groupBy("mi").agg(
        *[F.max(F.when(F.col("_column") == c, F.col("breakpoints")[0])).alias(f"_med_{c}") for c in columns]
    )
    rows = pool.join(written(medians, "medians"), "mi")

    def side(cond: Column) -> Column:
        w = F.when(cond, F.col("cap_prev"))
        return F.try_divide(F.sum(F.col("ret") * w), F.sum(w))

    return rows.groupBy("mi").agg(
        *[
            ((side(F.col(c) > F.col(f"_med_{c}")) - side(F.col(c) <= F.col(f"_med_{c}"))) * sign).alias(f)
            for f, (c, sign) in characteristics.items()
        ]
    )


def in_excess(series: DataFrame, rf: DataFrame, self_financing: Sequence[str] = ("long_short",)) -> DataFrame:
    """Portfolio series minus the rate of their month; a self-financing leg needs none."""
    rate = F.when(F.col("portfolio").isin(*self_financing), 0.0).otherwise(F.coalesce("rate", F.lit(0.0)))
    return series.join(rf.select("mi", "rate"), "mi", "left").withColumn("ret", F.col("ret") - rate).drop("rate")


def market_excess(market: DataFrame, rf: DataFrame) -> DataFrame:
    """(mi, MKT-RF) from the market's return."""
    rows = market.join(rf.select("mi", "rate"), "mi", "left")
    return rows.select("mi", (F.col("ret") - F.coalesce("rate", F.lit(0.0))).alias("MKT-RF"))


def capm(series: DataFrame, factors: DataFrame, market: str = "MKT-RF", keys: Sequence[str] = SERIES, lags: int = K.NEWEY_WEST_LAGS) -> DataFrame:
    """One-factor regression with HAC(lags) t of the alpha, entirely in built-in aggregates.

    With x = (1, m) the sandwich needs only lagged products of the scores u and u * m.
    """
    m = F.col("_m")
    rows = series.join(factors.select("mi", F.col(f"`{market}`").alias("_m")), "mi").dropna(subset=["ret", "_m"])
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("mi")
    slope = F.try_divide(F.covar_pop("ret", "_m").over(whole), F.var_pop("_m").over(whole))
    u = F.col("ret") - F.avg("ret").over(whole) - slope * (m - F.avg("_m").over(whole))
    # influence of each month on alpha: first row of (X'X)^-1 x u
    a = F.try_divide(
        (F.avg(m * m).over(whole) - F.avg("_m").over(whole) * m) * F.col("_u"),
        F.count("_m").over(whole) * F.var_pop("_m").over(whole),
    )
    rows = rows.withColumn("_u", u).withColumn("_a", a)
    lagged = [(F.col("_a") * F.lag("_a", l).over(ordered)).alias(f"_g{l}") for l in range(1, lags + 1)]
    var = F.sum(F.col("_a") * F.col("_a"))
    for l in range(1, lags + 1):
        var = var + 2 * (1 - l / (lags + 1)) * F.coalesce(F.sum(f"_g{l}"), F.lit(0.0))
    n = F.count(F.lit(1))
    loading = F.try_divide(F.covar_pop("ret", "_m"), F.var_pop("_m"))
    alpha = F.avg("ret") - loading * F.avg("_m")
    r2 = X.correlation("ret", "_m") * X.correlation("ret", "_m")
    return (
        rows.select(*keys, "ret", "_m", "_a", *lagged)
        .groupBy(*keys)
        .agg(
            alpha.alias("alpha"),
            loading.alias("loading"),
            F.try_divide(alpha, F.sqrt(F.when(var > 0, var))).alias("t_alpha"),
            (1 - (1 - r2) * F.try_divide((n - 1).cast("double"), (n - 2).cast("double"))).alias("adj_r2"),
            n.alias("n_months"),
        )
    )


def _regression(rows: DataFrame, keys: Sequence[str], factors: Sequence[str], lags: int) -> DataFrame:
    """Coefficients of one factor model with HAC t values, per series, in built-in aggregates.

    The normal equations are sums per series, solved with the identity as further right sides, which
    gives the inverse. A month's influence on a coefficient is its row of the inverse times the
    month's factors and residual; the sandwich's diagonal needs only sums of products of lagged
    influences. Series with fewer months than coefficients plus one are left out; a singular system
    gives NULLs.
    """
    names = [f"_f{i}" for i in range(len(factors))]
    k = len(factors) + 1
    rows = rows.select(*keys, "mi", "ret", *[F.col(f"`{f}`").alias(n) for f, n in zip(factors, names)]).dropna()
    z = [F.lit(1.0), *map(F.col, names)]
    moment = lambda i, j: F.sum(z[i] * z[j])
    system = [
        F.array(*[moment(min(i, j), max(i, j)) for j in range(k)], F.sum(z[i] * F.col("ret")), *[F.lit(float(i == j)) for j in range(k)]) for i in range(k)
    ]
    n = F.count(F.lit(1))
    sums = rows.groupBy(*keys).agg(F.array(*system).alias("_system"), (F.var_pop("ret") * n).alias("_total"), n.alias("n_months"))
    sums = written(sums.filter(F.col("n_months") > k), "normal-equations")  # a row per series
    solved = written(sums.withColumn("_solved", reduced(F.col("_system"), k)).drop("_system"), "solved")
    at = lambda i, j: F.get(F.get("_solved", F.lit(i)), F.lit(j))
    fitted = rows.join(solved, list(keys))
    u = F.col("ret") - sum((at(i, 0) * z[i] for i in range(1, k)), at(0, 0))
    fitted = fitted.withColumn("_u", u)
    influence = [sum((at(i, j + 1) * z[j] for j in range(1, k)), at(i, 1)) * F.col("_u") for i in range(k)]
    fitted = fitted.withColumns({f"_a{i}": a for i, a in enumerate(influence)})
    by_month = Window.partitionBy(*keys).orderBy("mi")  # a row per month
    lagged = [(F.col(f"_a{i}") * F.lag(f"_a{i}", l).over(by_month)).alias(f"_g{i}_{l}") for i in range(k) for l in range(1, lags + 1)]
    fitted = fitted.select(*keys, "_solved", "_total", "n_months", "_u", *[f"_a{i}" for i in range(k)], *lagged)

    def variance(i: int) -> Column:
        out = F.sum(F.col(f"_a{i}") * F.col(f"_a{i}"))
        for l in range(1, lags + 1):
            out = out + 2 * (1 - l / (lags + 1)) * F.coalesce(F.sum(f"_g{i}_{l}"), F.lit(0.0))
        return out

    out = fitted.groupBy(*keys, "_solved", "_total", "n_months").agg(F.sum(F.col("_u") * F.col("_u")).alias("_rest"), *[variance(i).alias(f"_v{i}") for i in range(k)])
    free = (F.col("n_months") - k).cast("double")
    adjusted = 1 - F.try_divide(F.col("_rest") / free, F.col("_total") / (F.col("n_months") - 1).cast("double"))
    terms = F.array(*[
        F.struct(F.lit(t).alias("term"), at(i, 0).alias("value"), F.try_divide(at(i, 0), F.sqrt(F.when(F.col(f"_v{i}") > 0, F.col(f"_v{i}")))).alias("t_value"))
        for i, t in enumerate(["alpha", *factors])
    ])
    return out.select(*keys, F.inline(terms), adjusted.alias("adj_r2"), "n_months")


def factor_alpha(
    series: DataFrame,
    factors: DataFrame,
    models: Mapping[str, Sequence[str]] = K.FACTOR_MODELS,
    keys: Sequence[str] = SERIES,
    lags: int = K.NEWEY_WEST_LAGS,
) -> DataFrame:
    """Alpha and loadings of each series on each factor model, long form.

    Output: keys, factor_model, term ('alpha' or a factor), value, t_value, adj_r2, n_months.
    """
    needed = sorted({f for fs in models.values() for f in fs})
    rows = series.select(*keys, "mi", "ret").join(factors.select("mi", *[F.col(f"`{f}`") for f in needed]), "mi")
    rows = written(rows, "factor-rows")
    out = None
    for name, fs in models.items():
        part = _regression(rows, keys, list(fs), lags)
        part = part.select(*keys, F.lit(name).alias("factor_model"), "term", "value", "t_value", "adj_r2", "n_months")
        out = part if out is None else out.unionByName(part)
    return out


def loadings(alphas: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Exposure table: (keys, factor_model, factor, loading)."""
    return alphas.filter(F.col("term") != "alpha").select(
        *keys, "factor_model", F.col("term").alias("factor"), F.col("value").alias("loading")
    )
