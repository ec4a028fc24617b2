import pytest
from pyspark.sql import functions as F

from panelloom.operators import performance as PF
from panelloom.operators import sorts as S
from panelloom.plans import jobs as J
from panelloom.plans.tables import tables

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_and_exclusions_only_drop_months(spark):
    t = tables(spark, SMALL)
    whole = J.decile_backtest(t.panel, t.scores, n=3, exchange_breakpoints=None)
    part = J.decile_backtest(t.panel, t.scores, n=3, exchange_breakpoints=None, period=("1997-01", "2000-12"), exclude=[("1998-01", "1998-06")])
    lo, hi = S.C.period_index("1997-01"), S.C.period_index("2000-12")
    a, b = S.C.period_index("1998-01"), S.C.period_index("1998-06")
    key = lambda r: (r.model, r.portfolio, r.mi)
    want = {key(r): r.ret for r in whole["returns"].collect() if lo <= r.mi <= hi and not a <= r.mi <= b}
    got = {key(r): r.ret for r in part["returns"].collect()}
    assert got.keys() == want.keys() and len(got) == 2 * 4 * 42
    assert all(got[k] == (None if want[k] is None else pytest.approx(want[k])) for k in got)
    assert part["performance"].count() == 8 and part["diagnostics"].count() == 84
    legs = part["holdings"].groupBy("model", "mi").agg(F.countDistinct("leg").alias("n")).select("n").distinct().collect()
    assert [r.n for r in legs] == [2]


def test_top_n_and_wide_curves(spark):
    t = tables(spark, SMALL)
    out = J.top_n_backtest(t.panel, t.scores, top=6, n=2)
    assert out["diagnostics"].agg(F.max("n_universe")).first()[0] == 6
    wide = PF.cumulative_wide(out["returns"], ["1", "2", "long_short"])
    assert set(wide.columns) == {"model", "mi", "1", "2", "long_short"}


def test_pool_join_reuses_the_bucketing(spark):
    t = tables(spark, SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(t.candidates.join(S.clean_scores(t.scores), ["mi", "id"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
