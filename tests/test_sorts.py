import numpy as np
import pytest

from panelloom.operators import sorts as S

CAND = "id long, mi int, cap_prev double, eligible boolean, ret double, exch string, listed boolean"


def cands(make, rows):
    return make([(i, m, c, e, r, x, True) for i, m, c, e, r, x in rows], CAND)


@pytest.fixture
def market():
    rng = np.random.default_rng(7)
    rows, scores = [], []
    for m in (100, 101):
        for i in range(60):
            rows.append((i, m, float(rng.uniform(1, 9)), i % 11 != 0, float(rng.normal()), "N" if i % 2 else "Q"))
            scores.append(("a", m, i, float(rng.normal())))
    return rows, scores


@pytest.mark.parametrize("exchange", [None, "N"])
def test_deciles_match_numpy(make, market, exchange):
    rows, scores = market
    sort = S.quantile_sort(cands(make, rows), make(scores, "model string, mi int, id long, score double"), 5, exchange_breakpoints=exchange)
    got = {(r.mi, r.portfolio): r.ret for r in S.portfolio_returns(sort).drop("date").collect()}
    sc = {(m, i): s for _, m, i, s in scores}
    for m in (100, 101):
        pool = [r for r in rows if r[1] == m and r[3]]
        ref = [sc[(m, r[0])] for r in pool if exchange is None or r[5] == exchange]
        bps = np.percentile(ref, [20, 40, 60, 80])
        want = {}
        for q in range(1, 6):
            mem = [r for r in pool if 1 + (sc[(m, r[0])] > bps).sum() == q]
            want[q] = sum(r[2] * r[4] for r in mem) / sum(r[2] for r in mem)
            assert got[(m, str(q))] == pytest.approx(want[q])
        assert got[(m, "long_short")] == pytest.approx(want[5] - want[1])
    assert sort.assigned.count() == sum(r[3] for r in rows)


def test_small_exchange_month_is_empty_but_reported(make):
    rows = [(i, 5, 1.0, True, 0.1, "N" if i < 3 else "A") for i in range(12)]
    sort = S.quantile_sort(cands(make, rows), make([(5, i, float(i)) for i in range(12)], "mi int, id long, score double"), 10, exchange_breakpoints="N")
    series = S.portfolio_returns(sort).drop("date").collect()
    assert len(series) == 11 and all(r.ret is None for r in series)
    d = S.sort_diagnostics(sort).first()
    assert (d.n_universe, d.n_pool, d.n_breakpoint, d["empty"], d.bp_unique) == (12, 12, 3, True, None)


def test_small_universe_month_is_left_out(make):
    rows = [(i, 5, 1.0, True, 0.1, "N") for i in range(4)]
    sort = S.quantile_sort(cands(make, rows), make([(5, i, float(i)) for i in range(4)], "mi int, id long, score double"), 5)
    assert sort.months.count() == 0


def test_equal_scores_all_go_to_the_lowest(make):
    rows = [(i, 5, 1.0, True, 0.1, "N") for i in range(10)]
    sort = S.quantile_sort(cands(make, rows), make([(5, i, 3.0) for i in range(10)], "mi int, id long, score double"), 5)
    assert {r.q for r in sort.assigned.collect()} == {1}
    got = {r.portfolio: r.ret for r in S.portfolio_returns(sort).drop("date").collect()}
    assert got["1"] == pytest.approx(0.1) and got["5"] is None and got["long_short"] is None


def test_nan_scores_are_missing(make):
    s = make([(5, 1, float("nan")), (5, 2, None), (5, 3, 1.0)], "mi int, id long, score double")
    assert [r.id for r in S.clean_scores(s).collect()] == [3]


def test_largest_names_counts_names(make, market):
    rows, scores = market
    sort = S.quantile_sort(cands(make, rows), make(scores, "model string, mi int, id long, score double"), 5, top=20)
    d = S.sort_diagnostics(sort).collect()
    assert all(r.n_universe == 20 for r in d)
    kept = {(r.mi, r.id) for r in sort.assigned.collect()}
    for m in (100, 101):
        pool = sorted([r for r in rows if r[1] == m and r[3]], key=lambda r: (-r[2], r[0]))[:20]
        assert {(m, r[0]) for r in pool} == {k for k in kept if k[0] == m}


def test_missing_caps(make):
    s = make([(1, i, float(i)) for i in range(4)] + [(2, i, float(i)) for i in range(4)], "mi int, id long, score double")
    r = make([(1, 0, 0.1, None), (1, 1, 0.3, 2.0), (1, 2, 0.5, 1.0), (1, 3, 0.7, 3.0), (2, 0, 0.1, None), (2, 1, 0.3, None), (2, 2, 0.5, 1.0), (2, 3, None, 3.0)],
             "mi int, id long, ret double, cap_prev double")
    got = {(x.mi, x.portfolio): x.ret for x in S.simple_sort(s, r, 2, "value").drop("date").collect()}
    assert got[(1, "1")] == pytest.approx(0.3)  # the name without a market value does not count
    assert got[(1, "2")] == pytest.approx((0.5 + 3 * 0.7) / 4)
    assert got[(2, "1")] == pytest.approx(0.2)  # no market value at all: equal weights
    assert got[(2, "2")] == pytest.approx(0.5)


def test_turnover(make):
    w = make([("m", 1, "p", 1, 1.0), ("m", 2, "p", 2, 1.0), ("m", 5, "p", 2, 0.5), ("m", 5, "p", 3, 0.5)],
             "model string, mi int, portfolio string, id long, weight double")
    assert {r.mi: r.turnover for r in S.turnover(w).drop("date").collect()} == {2: 1.0, 5: 0.5}


def test_top_k(make):
    s = make([(1, i, float(i % 3)) for i in range(6)] + [(2, 0, 1.0)], "mi int, id long, score double")
    r = make([(1, i, float(i)) for i in range(6)] + [(2, 0, 1.0)], "mi int, id long, ret double")
    got = {(x.mi, x.portfolio): x.ret for x in S.top_k_returns(s, r, (1, 2, 5)).drop("date").collect()}
    assert got == {(1, "top1"): 2.0, (1, "top2"): 3.5, (1, "top5"): pytest.approx((2 + 5 + 1 + 4 + 0) / 5), (2, "top1"): 1.0}


def test_nested_sort_partitions_the_pool(make, market):
    rows, scores = market
    pool = make([("a", m, i, r, c, s[3]) for (i, m, c, _, r, _x), s in zip(rows, scores)], "model string, mi int, id long, ret double, cap_prev double, score double")
    out = S.bivariate_sort(pool, "cap_prev", 3, 4).filter("portfolio != 'long_short'").collect()
    assert sum(r.n_names for r in out) == 120 and len({(r.q1, r.portfolio) for r in out}) == 12
