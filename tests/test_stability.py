import numpy as np
import pytest

from panelloom.operators import evaluate as E
from panelloom.operators import stability as ST


def test_similarity_excludes_both_training_periods(make):
    rng = np.random.default_rng(6)
    rows, per_month = [], {}
    for m in (24000, 24001, 24012, 24024):
        x, y = rng.normal(size=12), rng.normal(size=12)
        per_month[m] = np.corrcoef(x.argsort().argsort(), y.argsort().argsort())[0, 1]
        rows += [("a", m, i, float(v)) for i, v in enumerate(x)] + [("b", m, i, float(v)) for i, v in enumerate(y)]
    s = make(rows, "model string, mi int, id long, score double")
    out = ST.forecast_similarity(s, ["a", "b"], [("a", "2000-01", "2000-01"), ("b", "2001-01", "2001-12")]).first()
    assert out.n_months == 2
    assert out.forecast_correlation == pytest.approx((per_month[24001] + per_month[24024]) / 2)


def test_common_holdings(make):
    rows = [("a", 1, 1, "long"), ("a", 1, 2, "short"), ("b", 1, 1, "long"), ("b", 1, 2, "long"), ("b", 1, 3, "short"), ("b", 1, 4, "short"), ("a", 2, 1, "long")]
    out = ST.common_holdings(make(rows, "model string, mi int, id long, leg string"), ["a", "b"]).first()
    assert (out.common_holdings, out.n_months) == (pytest.approx(1 / 3), 1)


def test_earlier_window_wins(make):
    a = make([("w1", 1, 1, 0.1)], "model string, mi int, id long, score double")
    b = make([("w2", 1, 1, 0.9), ("w2", 2, 1, float("nan")), ("w2", 3, 1, 0.3)], "model string, mi int, id long, score double")
    assert {(r.mi, r.id): r.score for r in ST.merge_forecasts([a, b]).collect()} == {(1, 1): 0.1, (3, 1): 0.3}


def test_window_assignment(make):
    df = make([(ST.C.period_index("1963-06"),), (ST.C.period_index("1963-07"),), (ST.C.period_index("2022-12"),)], "mi int")
    got = {r.mi: r.window for r in ST.assign_window(df, ST.windows_table(df)).collect()}
    assert sorted(got.values()) == ["window_196306", "window_201412"]


def test_small_months_and_constant_scores(make):
    s = make([(1, i, 1.0) for i in range(12)] + [(2, i, float(i)) for i in range(9)], "mi int, id long, score double")
    r = make([(m, i, float(i)) for m in (1, 2) for i in range(12)], "mi int, id long, ret double")
    rows = E.monthly_spearman(s, r).drop("date").collect()
    assert [(x.mi, x.correlation) for x in rows] == [(1, None)]


def test_pooled_evaluation_wide_path(make):
    rng = np.random.default_rng(0)
    rows = [("m", float(round(a, 1)), float(round(b, 1))) for a, b in rng.normal(size=(200, 2))]
    df = make(rows, "model string, score double, ret double")
    a = E.pooled_evaluation(df).first()
    pdf = df.toPandas()
    want = pdf.score.rank().corr(pdf.ret.rank())
    assert a.spearman == pytest.approx(want) and a.n_observations == 200
