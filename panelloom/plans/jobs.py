"""Whole jobs composed from operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .. import constants as K
from ..operators import sorts as S
from ..operators.panel import candidates
from ..operators.performance import performance
from ..operators.store import written


def decile_backtest(
    panel: DataFrame,
    scores: DataFrame,
    n: int = K.N_PORTFOLIOS,
    period: tuple[str, str] | None = None,
    exclude: Sequence[tuple[str, str]] = (),
    top: int | None = None,
    exchange_breakpoints: str | None = K.NYSE,
    lags: int = K.NEWEY_WEST_LAGS,
) -> dict[str, DataFrame]:
    """Stored forecasts to portfolio returns, diagnostics and performance."""
    sort = S.quantile_sort(candidates(panel), scores, n, period, exclude, top, exchange_breakpoints)
    series = written(S.portfolio_returns(sort), "series")
    return {
        "returns": series,
        "diagnostics": S.sort_diagnostics(sort),
        "performance": performance(series, lags=lags),
        "holdings": S.extreme_holdings(sort),
    }


def top_n_backtest(panel: DataFrame, scores: DataFrame, top: int = K.TOP_N, **kw) -> dict[str, DataFrame]:
    """Deciles of the ``top`` largest names with their own breakpoints."""
    return decile_backtest(panel, scores, top=top, exchange_breakpoints=None, **kw)


def quick_backtest(scores: DataFrame, returns: DataFrame, n: int = K.N_PORTFOLIOS, weighting: str = "equal") -> DataFrame:
    """Performance of portfolios sorted on given scores."""
    return performance(written(S.simple_sort(scores, returns, n, weighting), "series"))


def top_k_backtest(scores: DataFrame, returns: DataFrame, ks: Sequence[int] = K.TOP_K) -> DataFrame:
    return performance(written(S.top_k_returns(scores, returns, ks), "series"))
