"""Portfolio sorts: quantile portfolios, nested sorts, top-k baskets, holdings, turnover.

Everything is keyed by ``(model, mi)``, so several score columns or models run in one job. The
pool of a sort is written once: it is read for the breakpoints and again for the assignment,
and both must see the same scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as C
from ..functions.scalars import nan_to_null
from . import crosssection as X
from .store import written

MONTH = ["model", "mi"]
LONG_SHORT = "long_short"


def clean_scores(scores: DataFrame) -> DataFrame:
    """Scores without NULL and NaN; adds a ``model`` column when there is none."""
    if "model" not in scores.columns:
        scores = scores.withColumn("model", F.lit("score"))
    return scores.select("model", "mi", "id", nan_to_null("score").alias("score")).filter(F.col("score").isNotNull())


def prior_caps(panel: DataFrame, cap: str = "mcap") -> DataFrame:
    """Market value at the end of the month before, by calendar month."""
    return panel.filter(F.col(cap) > 0).select("id", (F.col("mi") + 1).alias("mi"), F.col(cap).alias("cap_prev"))


def largest_names(cands: DataFrame, n: int = K.TOP_N) -> DataFrame:
    """The ``n`` largest securities of each month by prior market value (ties by id)."""
    return X.top_n(
        cands.filter(F.col("cap_prev").isNotNull()), ["mi"], [F.col("cap_prev").desc(), F.col("id")], n, position="size_rank"
    )


def size_screen(cands: DataFrame, percentile: float, exchange: str = K.NYSE) -> DataFrame:
    """Securities whose prior market value exceeds a percentile of the exchange's names."""
    known = written(cands.filter(F.col("cap_prev").isNotNull()), "size_known")
    cut = X.quantiles(known.filter(F.col("exch") == exchange), ["mi"], "cap_prev", [percentile])
    cut = written(cut.select("mi", F.col("breakpoints")[0].alias("_cut")), "size_cut")
    return known.join(cut, "mi").filter(F.col("cap_prev") > F.col("_cut")).drop("_cut")


# ---------------------------------------------------------------- quantile sort


class QuantileSort:
    """The tables of one sort: month table and assigned pool (both written)."""

    def __init__(self, months: DataFrame, assigned: DataFrame, n: int):
        self.months = months
        self.assigned = assigned
        self.n = n


def quantile_sort(
    cands: DataFrame,
    scores: DataFrame,
    n: int = K.N_PORTFOLIOS,
    period: tuple[str, str] | None = None,
    exclude: Sequence[tuple[str, str]] = (),
    top: int | None = None,
    exchange_breakpoints: str | None = None,
    eligible_only: bool = True,
) -> QuantileSort:
    """Sort the eligible securities of each month into ``n`` portfolios by score.

    Universe: eligible securities with a prior market value, optionally the ``top`` largest.
    Months whose universe is smaller than ``n`` are left out. Pool: universe with a score and a
    return. A month whose pool (or whose breakpoint exchange) has fewer than ``n`` names stays
    as an empty month. Breakpoints are linear percentiles of the pool, or of its names on one
    exchange; a score on a breakpoint belongs to the lower portfolio.
    """
    keep = F.col("cap_prev").isNotNull()
    if eligible_only:
        keep = keep & F.col("eligible")
    if period:
        keep = keep & C.in_period("mi", *period)
    if exclude:
        keep = keep & ~C.in_any_period("mi", exclude)
    is_eligible = F.count(F.when(F.col("eligible"), 1)).alias("n_eligible")
    if top is None:
        universe = cands.filter(keep)
        sizes = cands.groupBy("mi").agg(
            is_eligible, F.count(F.when(keep, 1)).alias("n_universe"), F.count(F.when(keep, F.col("ret"))).alias("_returns")
        )
    else:
        universe = largest_names(cands.filter(keep), top)
        sizes = (
            universe.groupBy("mi")
            .agg(F.count(F.lit(1)).alias("n_universe"), F.count("ret").alias("_returns"))
            .join(cands.groupBy("mi").agg(is_eligible), "mi")
        )
    sizes = sizes.filter((F.col("n_universe") >= n) & (F.col("_returns") > 0)).drop("_returns")
    universe = universe.select("mi", "id", "cap_prev", "ret", "exch")

    scores = clean_scores(scores)
    in_bp = F.col("exch") == exchange_breakpoints if exchange_breakpoints else F.lit(True)
    pool = written(
        universe.filter(F.col("ret").isNotNull())
        .join(scores, ["mi", "id"])
        .select("model", "mi", "id", "score", "cap_prev", "ret", F.when(in_bp, F.col("score")).alias("bp_score")),
        "pool",
    )
    bps = X.breakpoints(pool, MONTH, "bp_score", n, rows="n_pool", values="n_bp")
    n_pool, n_bp = F.coalesce("n_pool", F.lit(0)), F.coalesce("n_bp", F.lit(0))
    enough = (n_pool >= n) & (n_bp >= n)
    months = written(
        scores.select(*MONTH)
        .distinct()
        .join(sizes, "mi")
        .join(bps, MONTH, "left")
        .select(
            *MONTH, "n_eligible", "n_universe", n_pool.alias("n_pool"), n_bp.alias("n_bp"),
            (~enough).alias("empty"), F.when(enough, F.col("breakpoints")).alias("breakpoints"),
        ),
        "sort_months",
    )
    assigned = (
        pool.join(months.filter(~F.col("empty")).select(*MONTH, "breakpoints"), MONTH)
        .withColumn("q", X.quantile_of("score", "breakpoints"))
        .select(*MONTH, "id", "q", "score", "cap_prev", "ret")
    )
    return QuantileSort(months, assigned, n)


def weighted_return(ret: str = "ret", cap: str = "cap_prev", weighting: str = "value") -> Column:
    """Value-weighted over names with a market value, equal-weighted when there is none."""
    equal = F.avg(ret)
    if weighting == "equal":
        return equal
    if weighting != "value":
        raise ValueError(f"unknown weighting {weighting!r}")
    w = F.when(F.col(ret).isNotNull(), F.col(cap))
    return F.coalesce(F.try_divide(F.sum(F.col(ret) * w), F.sum(w)), equal)


def value_weighted_return(ret: str = "ret", cap: str = "cap_prev") -> Column:
    """Strictly value-weighted: only names with a positive market value count."""
    w = F.when(F.col(ret).isNotNull() & (F.col(cap) > 0), F.col(cap))
    return F.try_divide(F.sum(F.col(ret) * w), F.sum(w))


def with_long_short(series: DataFrame, n: int, keys: Sequence[str] = ("model", "mi")) -> DataFrame:
    """Adds P_n - P_1 per month; NULL when a leg is missing."""
    leg = lambda q: F.max(F.when(F.col("portfolio") == str(q), F.col("ret")))
    names = lambda q: F.max(F.when(F.col("portfolio") == str(q), F.col("n_names")))
    spread = series.groupBy(*keys).agg((leg(n) - leg(1)).alias("ret"), (names(n) + names(1)).alias("n_names"))
    return series.unionByName(spread.withColumn("portfolio", F.lit(LONG_SHORT)))


def portfolio_returns(sort: QuantileSort, weighting: str = "value", long_short: bool = True) -> DataFrame:
    """Return of every portfolio in every month of the sort; NULL where a portfolio is empty."""
    measured = sort.assigned.groupBy(*MONTH, F.col("q").cast("string").alias("portfolio")).agg(
        weighted_return(weighting=weighting).alias("ret"), F.count(F.lit(1)).alias("n_names")
    )
    grid = sort.months.select(*MONTH, F.explode(F.array(*[F.lit(str(q)) for q in range(1, sort.n + 1)])).alias("portfolio"))
    series = grid.join(measured, [*MONTH, "portfolio"], "left").select(
        *MONTH, "portfolio", "ret", F.coalesce("n_names", F.lit(0)).cast("long").alias("n_names")
    )
    if long_short:
        series = with_long_short(series, sort.n)
    return series.select("model", "portfolio", "mi", C.month_end("mi").alias("date"), "ret", "n_names")


def sort_diagnostics(sort: QuantileSort) -> DataFrame:
    """One row per month: sizes of the sets, of both extreme portfolios, distinct breakpoints."""
    leg = lambda q: F.count(F.when(F.col("q") == q, 1))
    legs = sort.assigned.groupBy(*MONTH).agg(leg(1).alias("n_low"), leg(sort.n).alias("n_high"))
    return (
        sort.months.join(legs, MONTH, "left")
        .withColumn("bp_unique", F.size(F.array_distinct("breakpoints")))
        .withColumn("bp_unique", F.when(~F.col("empty"), F.col("bp_unique")))
        .select(
            *MONTH,
            C.ym_of_index("mi").alias("ym"),
            "n_eligible",
            "n_universe",
            "n_pool",
            F.col("n_bp").alias("n_breakpoint"),
            "n_low",
            "n_high",
            "bp_unique",
            "empty",
        )
    )


def extreme_holdings(sort: QuantileSort) -> DataFrame:
    """Members of the long and the short leg, for months where both have a return."""
    legs = (
        sort.assigned.filter(F.col("q").isin(1, sort.n))
        .withColumn("leg", F.when(F.col("q") == sort.n, "long").otherwise("short"))
        .select(*MONTH, "leg", "id", "cap_prev", "ret")
    )
    both = (
        legs.groupBy(*MONTH)
        .agg(F.countDistinct("leg").alias("_legs"))
        .filter(F.col("_legs") == 2)
    )
    return legs.join(both.select(*MONTH), MONTH, "left_semi")


def holding_weights(sort: QuantileSort, weighting: str = "value") -> DataFrame:
    """Weight of every security in its portfolio and month."""
    w = F.col("cap_prev") if weighting == "value" else F.lit(1.0)
    totals = written(
        sort.assigned.groupBy(*MONTH, "q").agg(F.sum(w).alias("_total")), "weights_total"
    )
    return sort.assigned.join(totals, [*MONTH, "q"]).select(
        *MONTH, F.col("q").cast("string").alias("portfolio"), "id", F.try_divide(w, F.col("_total")).alias("weight")
    )


def turnover(weights: DataFrame) -> DataFrame:
    """Half the sum of absolute weight changes against the portfolio's previous date.

    A weight missing on one side counts as 0 and the first date has no value. One window per
    (model, portfolio, id): each row pays its own change and, when it leaves, its exit.
    """
    keys = ["model", "portfolio"]
    by_series = Window.partitionBy(*keys)
    dates = weights.select(*keys, "mi").distinct().select(
        *keys,
        "mi",
        F.row_number().over(by_series.orderBy("mi")).alias("pos"),
        F.count(F.lit(1)).over(by_series).alias("_last"),
    )
    dates = written(dates, "turnover_dates")
    by_name = Window.partitionBy(*keys, "id").orderBy("pos")
    stays = F.coalesce(F.lead("pos").over(by_name) == F.col("pos") + 1, F.lit(False))
    held = F.coalesce(F.when(F.lag("pos").over(by_name) == F.col("pos") - 1, F.lag("weight").over(by_name)), F.lit(0.0))
    moves = weights.join(dates, [*keys, "mi"]).select(
        *keys,
        F.array(
            F.struct(F.col("pos").alias("pos"), F.abs(F.col("weight") - held).alias("change")),
            F.struct(
                (F.col("pos") + 1).alias("pos"),
                F.when(~stays & (F.col("pos") < F.col("_last")), F.abs("weight")).alias("change"),
            ),
        ).alias("_m"),
    )
    per_date = (
        moves.select(*keys, F.inline("_m"))
        .filter(F.col("change").isNotNull() & (F.col("pos") > 1))
        .groupBy(*keys, "pos")
        .agg((F.sum("change") / 2).alias("turnover"))
    )
    return per_date.join(dates, [*keys, "pos"]).select(*keys, "mi", C.month_end("mi").alias("date"), "turnover")


# ---------------------------------------------------------------- simple construct


def simple_sort(
    scores: DataFrame,
    returns: DataFrame,
    n: int = K.N_PORTFOLIOS,
    weighting: str = "equal",
    exchange_breakpoints: str | None = None,
) -> DataFrame:
    """Quantile portfolios from scores and returns alone.

    Breakpoints use every scored name of the month (or those on one exchange), whether or not
    it has a return; returns are averaged over the names that have one. ``returns`` has
    (mi, id, ret) and, for value weights, ``cap_prev``; ``exch`` when breakpoints need it.
    """
    scores = clean_scores(scores)
    have = [c for c in ("ret", "cap_prev", "exch") if c in returns.columns]
    missing = {"cap_prev"} - set(have) if weighting == "value" else set()
    if missing:
        raise ValueError("value weights need a cap_prev column")
    months = returns.select("mi").distinct()
    rows = scores.join(months, "mi", "left_semi").join(returns.select("mi", "id", *have), ["mi", "id"], "left")
    in_bp = F.col("exch") == exchange_breakpoints if exchange_breakpoints else F.lit(True)
    rows = written(rows.withColumn("bp_score", F.when(in_bp, F.col("score"))), "simple_pool")
    bps = written(X.breakpoints(rows, MONTH, "bp_score", n).filter(F.col("n_values") >= n), "simple_bps")
    assigned = rows.join(bps.select(*MONTH, "breakpoints"), MONTH).withColumn(
        "q", X.quantile_of("score", "breakpoints")
    )
    measured = assigned.groupBy(*MONTH, F.col("q").cast("string").alias("portfolio")).agg(
        weighted_return(weighting=weighting).alias("ret"), F.count("ret").alias("n_names")
    )
    grid = bps.select(*MONTH, F.explode(F.array(*[F.lit(str(q)) for q in range(1, n + 1)])).alias("portfolio"))
    series = grid.join(measured, [*MONTH, "portfolio"], "left").select(
        *MONTH, "portfolio", "ret", F.coalesce("n_names", F.lit(0)).cast("long").alias("n_names")
    )
    return with_long_short(series, n).select(
        "model", "portfolio", "mi", C.month_end("mi").alias("date"), "ret", "n_names"
    )


# ---------------------------------------------------------------- nested sorts


def nested_sort(
    pool: DataFrame,
    levels: Sequence[tuple[str, int]],
    weighting: str = "value",
) -> DataFrame:
    """Dependent sorts: by the first column, then by the second inside each group, and so on.

    ``pool`` has (model, mi, id, ret, cap_prev) and the sort columns. Two levels make a bivariate
    sort, three a trivariate one. Groups with fewer names than parts are left out. Returns one
    row per month and cell (columns q1, q2, ...), and P_n - P_1 of the last level as
    ``portfolio = 'long_short'``.
    """
    cells: list[str] = []
    rows = written(pool.dropna(subset=[c for c, _ in levels] + ["ret"]), "nested_pool")
    for i, (column, parts) in enumerate(levels, start=1):
        by = [*MONTH, *cells]
        bps = X.breakpoints(rows, by, column, parts).filter(F.col("n_values") >= parts)
        bps = written(bps.select(*by, "breakpoints"), f"nested_bps{i}")
        rows = rows.join(bps, by).withColumn(f"q{i}", X.quantile_of(column, "breakpoints")).drop("breakpoints")
        if i < len(levels):
            rows = written(rows, f"nested_level{i}")
        cells.append(f"q{i}")
    last, n = cells[-1], levels[-1][1]
    series = (
        rows.groupBy(*MONTH, *cells[:-1], F.col(last).cast("string").alias("portfolio"))
        .agg(weighted_return(weighting=weighting).alias("ret"), F.count(F.lit(1)).alias("n_names"))
        .select(*MONTH, *cells[:-1], "portfolio", "ret", "n_names")
    )
    return with_long_short(series, n, [*MONTH, *cells[:-1]])


def bivariate_sort(pool, control: str, n_control: int = K.CONTROL_GROUPS, n: int = K.N_PORTFOLIOS, **kw) -> DataFrame:
    return nested_sort(pool, [(control, n_control), ("score", n)], **kw)


def trivariate_sort(pool, first: str, second: str, n_first: int, n_second: int, n: int, **kw) -> DataFrame:
    return nested_sort(pool, [(first, n_first), (second, n_second), ("score", n)], **kw)


# ---------------------------------------------------------------- top-k baskets


def top_k_returns(scores: DataFrame, returns: DataFrame, ks: Sequence[int] = K.TOP_K) -> DataFrame:
    """Equal-weighted return of the k best-scored names; months with fewer than k are left out.

    All k in one pass: the largest k decides what is kept, and each kept row counts towards
    every k that reaches it.
    """
    scored = clean_scores(scores).join(returns.filter(F.col("ret").isNotNull()).select("mi", "id", "ret"), ["mi", "id"])
    sizes = scored.groupBy(*MONTH).agg(F.count(F.lit(1)).alias("_n"))
    best = X.top_n(scored, MONTH, [F.col("score").desc(), F.col("id")], max(ks))
    reach = F.filter(F.array(*[F.lit(int(k)) for k in sorted(set(ks))]), lambda k: F.col("rn") <= k)
    return (
        best.withColumn("k", F.explode(reach))
        .groupBy(*MONTH, "k")
        .agg(F.avg("ret").alias("ret"), F.count(F.lit(1)).alias("n_names"))
        .join(sizes, MONTH)
        .filter(F.col("_n") >= F.col("k"))
        .select(
            "model", F.concat(F.lit("top"), F.col("k")).alias("portfolio"), "mi",
            C.month_end("mi").alias("date"), "ret", "n_names",
        )
    )
