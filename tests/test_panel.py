import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelloom.operators import panel as P
from panelloom.plans.tables import build_panel


def test_month_end_ties_give_one_calendar_row(make):
    daily = make(
        [(1, dt.date(2011, 4, 28), 5.0), (2, dt.date(2011, 4, 29), 7.0), (2, dt.date(2011, 4, 1), 1.0)],
        "id long, date date, close double",
    )
    rows = P.month_end_close(daily).orderBy("id").collect()
    assert [(r.date, r.last_trade, r.price) for r in rows] == [
        (dt.date(2011, 4, 30), dt.date(2011, 4, 28), 5.0), (dt.date(2011, 4, 30), dt.date(2011, 4, 29), 7.0)]


def test_returns_leave_gaps_missing(make):
    p = make([(1, 10, 2.0), (1, 11, 3.0), (1, 13, 6.0), (1, 14, 3.0)], "id long, mi int, price double")
    assert [r.ret for r in P.simple_returns(p).orderBy("mi").collect()] == [None, 0.5, None, -0.5]


def test_forward_fill_stops_at_the_panel_end_and_flags(make):
    p = make([(1, 10, 2.0), (1, 12, 3.0), (2, 10, 1.0), (2, 11, 1.0), (2, 13, None), (3, 14, 5.0)], "id long, mi int, price double")
    got = {(r.id, r.mi): (r.price, r.filled) for r in P.forward_fill(p).drop("date").collect()}
    assert got[(1, 11)] == (2.0, True) and got[(1, 12)] == (3.0, False) and got[(1, 14)] == (3.0, True)
    assert got[(2, 13)] == (1.0, True) and (3, 13) not in got


def test_duplicate_keys_keep_one(make):
    df = make([(1, 5, 1.0), (1, 5, 9.0), (1, 6, 2.0)], "id long, mi int, cap double")
    assert sorted(map(tuple, P.keep_one(df, ["id", "mi"], ["cap"]).collect())) == [(1, 5, 9.0), (1, 6, 2.0)]
    assert sorted(map(tuple, P.keep_one(df, ["id", "mi"], ["cap"], "first").collect())) == [(1, 5, 1.0), (1, 6, 2.0)]


def test_eligibility_needs_every_month(panel):
    rows = [(1, m, 0.1) for m in range(100, 126)] + [(2, m, 0.1) for m in range(100, 126) if m != 105]
    rows += [(3, m, None if m == 110 else 0.1) for m in range(100, 126)]
    got = {}
    for r in P.eligibility(panel(rows)).collect():
        got.setdefault(r.id, set()).add(r.mi)
    assert got[1] == set(range(112, 126))
    assert got[2] == set(range(118, 126))
    assert got[3] == set(range(123, 126))


def test_training_eligibility_needs_the_prior_cap(panel):
    rows = [(1, m, 0.1, 0.0 if m == 112 else 5.0) for m in range(100, 115)]
    assert sorted(r.mi for r in P.training_eligibility(panel(rows)).collect()) == [112, 114]


def test_candidates_agree_with_the_separate_operators(panel):
    import random

    random.seed(3)
    rows = [(i, m, random.random() if random.random() > 0.05 else None, random.random() * 10 - 0.5, random.choice("NAQ"))
            for i in range(20) for m in range(100, 140) if random.random() > 0.05]
    p = panel(rows)
    got = {(r.id, r.mi): r for r in P.candidates(p).collect()}
    elig = {(r.id, r.mi) for r in P.eligibility(p).collect()}
    by = {(r[0], r[1]): r for r in rows}
    for (i, m), c in got.items():
        before, now = by[(i, m - 1)], by.get((i, m))
        assert c.cap_prev == (before[3] if before[3] > 0 else None)
        assert c.ret == (now[2] if now else None) and c.listed == (now is not None)
        if m <= 139:
            assert c.eligible == ((i, m) in elig)


def test_complete_months_and_empty_series(make):
    p = make([(1, 1, 0.1), (2, 1, None), (1, 2, 0.1), (2, 2, 0.2)], "id long, mi int, ret double")
    assert {r.mi for r in P.complete_months(p).collect()} == {2}
    q = make([(1, 1, None), (1, 2, None), (2, 1, 3.0)], "id long, mi int, price double")
    assert {r.id for r in P.drop_empty_series(q).collect()} == {2}


def test_requested_ids(make):
    asked = make([("1",), (" 2 ",), ("x3",), ("99",)], "id string")
    p = make([(1,), (2,), (3,)], "id long")
    ids = P.integer_ids(asked)
    assert sorted(r.id for r in P.keep_ids(p, ids).collect()) == [1, 2]
    assert [r.id for r in P.missing_ids(p, ids).collect()] == [99]
    with pytest.raises(ValueError):
        P.keep_ids(p, [])


def test_missing_rate_counts_as_zero(panel, make):
    p = panel([(1, 5, 0.5), (1, 6, None), (1, 7, 0.5)]).withColumn("date", F.lit(dt.date(2000, 1, 31)))
    rf = make([(5, 0.1)], "mi int, rate double")
    assert [r.ret for r in P.excess_returns(p, rf).orderBy("mi").collect()] == [0.4, None, 0.5]


def test_sums_do_not_depend_on_the_order_of_the_rows(spark, tmp_path):
    # two securities with the same lines in opposite orders
    lines = [(0.1 + 1000 / k, float(k % 7 + 1)) for k in range(1, 400)]
    rows = [(s, dt.datetime(1999, 1, 5), *line) for s, part in ((1, lines), (2, lines[::-1])) for line in part]
    schema = "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1), (2, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    a, b = build_panel(spark, str(tmp_path)).orderBy("id").collect()
    assert (a.price, a.mcap) == (b.price, b.mcap)
    assert a.mcap == pytest.approx(math.fsum(x for x, _ in lines), rel=1e-14)
    assert a.price == pytest.approx(math.fsum(x / q for x, q in lines) / len(lines), rel=1e-14)
