import numpy as np
import pytest

from panelloom.operators import factors as FA
from panelloom.operators import performance as PF

SCHEMA = "model string, portfolio string, mi int, ret double"


def series(make, values, portfolio="p"):
    return make([("m", portfolio, 100 + i, None if v is None else float(v)) for i, v in enumerate(values)], SCHEMA)


def newey_west(r, lags=12):
    r = np.asarray(r)
    d, n = r - r.mean(), len(r)
    if n < lags + 2:
        return r.mean() / (r.std() / np.sqrt(n))
    v = (d @ d) / n + sum(2 * (1 - l / (lags + 1)) * (d[l:] @ d[:-l]) / n for l in range(1, lags + 1))
    return r.mean() / np.sqrt(v / n)


def test_drawdown_starts_at_the_first_value(make):
    rows = PF.drawdowns(series(make, [0.1, -0.5, 0.2])).orderBy("mi").collect()
    assert [r.value for r in rows] == pytest.approx([1.1, 0.55, 0.66])
    assert [r.drawdown for r in rows] == pytest.approx([0, -0.5, -0.4])


@pytest.mark.parametrize("n", [10, 13, 14, 60])
def test_performance_row(make, n):
    r = np.random.default_rng(n).normal(0.01, 0.05, n)
    values = list(r[:5]) + [None] + list(r[5:])
    p = PF.performance(series(make, values)).first()
    cum = np.cumprod(1 + r)
    peak = np.maximum.accumulate(cum)
    assert p.n_months == n
    assert p.mean_return == pytest.approx(r.mean()) and p.std_dev == pytest.approx(r.std())
    assert p.sharpe_ratio == pytest.approx(r.mean() / r.std() * 12**0.5)
    assert p.t_statistic == pytest.approx(newey_west(r))
    assert p.annualized_return == pytest.approx(cum[-1] ** (12 / n) - 1)
    assert p.max_drawdown == pytest.approx(((cum - peak) / peak).min())


def test_empty_and_constant_series(make):
    assert PF.performance(series(make, [None, None])).first().n_months == 0
    p = PF.performance(series(make, [0.5] * 20)).first()
    assert p.sharpe_ratio == 0 and p.t_statistic is None


def test_extended_metrics(make):
    r = np.random.default_rng(4).normal(0.0, 0.05, 40)
    m = PF.extended_metrics(series(make, r), rf=0.002).first()
    e, d = r - 0.002, r - r.mean()
    down = e[e < 0]
    assert m.skewness == pytest.approx((d**3).mean() / r.std() ** 3)
    assert m.kurtosis == pytest.approx((d**4).mean() / r.std() ** 4 - 3)
    assert m.sortino_ratio == pytest.approx(e.mean() / down.std() * 12**0.5)
    assert m.annualized_return == pytest.approx((1 + r.mean()) ** 12 - 1)
    assert PF.extended_metrics(series(make, [0.1, 0.2])).first().sortino_ratio is None


def test_tail_risk(make):
    r = np.random.default_rng(9).normal(0, 0.05, 41)
    v = PF.value_at_risk(series(make, r)).first()
    cut = np.percentile(r, 5)
    assert v.var_historical == pytest.approx(cut) and v.cvar == pytest.approx(r[r <= cut].mean())


def test_costs(make):
    s = series(make, [0.1]).unionByName(series(make, [0.1], "long_short"))
    assert {r.portfolio: r.ret for r in PF.net_of_costs(s).collect()} == {"p": pytest.approx(0.0998), "long_short": pytest.approx(0.0996)}


def test_rolling(make):
    s = series(make, [0.1, None, 0.3, 0.4])
    a = [r.rolling_mean for r in PF.rolling_stats(s, window=3).orderBy("mi").collect()]
    assert a[:2] == [None, None] and a[2:] == pytest.approx([0.2, 0.35])
    b = [r.rolling_mean for r in PF.rolling_stats(s, window=2, skip_missing=False).orderBy("mi").collect()]
    assert b[:3] == [None] * 3 and b[3] == pytest.approx(0.35)


def test_beta_and_information_ratio(make):
    rng = np.random.default_rng(3)
    m = rng.normal(0, 1, 30)
    r = 0.5 * m + rng.normal(0, 0.1, 30)
    bench = make([(100 + i, float(x)) for i, x in enumerate(m)], "mi int, ret double")
    assert PF.beta(series(make, r), bench).first().beta == pytest.approx(np.cov(r, m)[0, 1] / m.var())
    assert PF.information_ratio(series(make, r), bench).first().information_ratio == pytest.approx((r - m).mean() / (r - m).std() * 12**0.5)
    flat = make([(100 + i, 1.0) for i in range(30)], "mi int, ret double")
    assert PF.beta(series(make, r), flat).first().beta == 0


def test_factor_models_agree(make):
    rng = np.random.default_rng(8)
    f = rng.normal(0, 1, (50, 2))
    r = 0.2 + f @ [1.0, -0.5] + rng.normal(0, 0.3, 50)
    factors = make([(100 + i, float(a), float(b)) for i, (a, b) in enumerate(f)], "mi int, `MKT-RF` double, SMB double")
    s = series(make, r)
    out = {(x.factor_model, x.term): x for x in FA.factor_alpha(s, factors, {"one": ("MKT-RF",), "two": ("MKT-RF", "SMB")}).collect()}
    x = np.column_stack([np.ones(50), f])
    want = np.linalg.lstsq(x, r, rcond=None)[0]
    assert [out[("two", t)].value for t in ("alpha", "MKT-RF", "SMB")] == pytest.approx(list(want))
    capm = FA.capm(s, factors).first()
    assert capm.alpha == pytest.approx(out[("one", "alpha")].value)
    assert capm.t_alpha == pytest.approx(out[("one", "alpha")].t_value)
    assert capm.adj_r2 == pytest.approx(out[("one", "alpha")].adj_r2)
    # the alpha of a model without factors is the mean with its Newey-West t
    flat = PF.newey_west(s).first()
    assert flat.t_statistic == pytest.approx(newey_west(r))


def test_correlation_matrix_is_pairwise_complete(make):
    s = series(make, [0.1, 0.2, None, 0.5], "a").unionByName(series(make, [0.3, 0.1, 0.9, 0.2], "b"))
    got = {(r.portfolio, r.other): r.correlation for r in PF.correlation_matrix(s, ["a", "b"]).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef([0.1, 0.2, 0.5], [0.3, 0.1, 0.2])[0, 1]) and len(got) == 4
