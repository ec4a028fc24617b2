import datetime as dt
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import features as FT


@pytest.fixture(scope="module")
def returns():
    rng = np.random.default_rng(2)
    return {(i, m): float(rng.normal(0.01, 0.1)) for i in range(6) for m in range(100, 130) if not (i == 3 and m == 115)}


def frame(panel, returns):
    rows = [(i, m, r, 1.0 + i) for (i, m), r in returns.items()]
    return panel(rows).withColumn("date", F.lit(dt.date(2000, 1, 31)))


@pytest.mark.parametrize("anchor", ["trailing", "oldest"])
def test_cumulative_returns(panel, returns, anchor):
    got = {(r.id, r.mi): r for r in FT.cumulative_returns(frame(panel, returns), anchor=anchor).collect()}
    for (i, m), row in got.items():
        for k in range(1, 13):
            months = range(m - k + 1, m + 1) if anchor == "trailing" else range(m - 11, m - 11 + k)
            have = [returns.get((i, x)) for x in months]
            want = None if None in have else np.prod([1 + h for h in have]) - 1
            assert row[f"cr{k}"] == (None if want is None else pytest.approx(want, abs=1e-12)), (i, m, k)


def test_features_ignore_the_present_and_the_future(panel, returns):
    t = 120
    changed = {k: (v if k[1] < t else v * -3 + 1) for k, v in returns.items()}
    pick = lambda rs: {r.id: r for r in FT.lagged_features(frame(panel, rs)).filter(F.col("mi") == t).collect()}
    assert pick(returns) == pick(changed) and len(pick(returns)) == 5


def test_targets(make):
    df = make([(i, 1, r) for i, r in enumerate([-0.01, 0.0, 0.01])] + [(9, 2, 0.5), (8, 2, 0.5)], "id long, mi int, ret double")
    get = lambda kind: {r.id: r.target for r in FT.target(df, kind).collect()}
    q = NormalDist().inv_cdf(0.75)
    assert [get("ret_rank_norm")[i] for i in range(3)] == pytest.approx([-q, 0, q])
    assert [get("ret_pctl")[i] for i in (0, 1, 2, 8, 9)] == pytest.approx([1 / 3, 2 / 3, 1, 0.75, 0.75])
    s = np.std([-0.01, 0, 0.01])
    assert [get("ret_norm")[i] for i in (0, 9)] == pytest.approx([-0.01 / s, 0.0])
    assert [get("ret_std")[i] for i in (0, 9)] == pytest.approx([-0.01 / s, 0.5])
    with pytest.raises(ValueError):
        FT.target(df, "other")


def test_weights(make):
    df = make([(1, 1, 3.0), (2, 1, None), (1, 2, None), (2, 2, None), (3, 2, None), (4, 2, None)], "id long, mi int, cap_prev double")
    get = lambda s: {(r.id, r.mi): r.weight for r in FT.sample_weights(df, s).collect()}
    w = get("ewpm")
    assert w[(1, 1)] == pytest.approx(1 / 4) and w[(1, 2)] == pytest.approx(1 / 8)
    v = get("ewpmvw")
    assert v[(1, 1)] == pytest.approx(0.5) and v[(2, 1)] == 0 and v[(3, 2)] == pytest.approx(1 / 8)
    for s in FT.WEIGHTS:
        assert sum(get(s).values()) == pytest.approx(1)


def test_samples_look_back_only(panel, returns):
    s = FT.feature_samples(frame(panel, returns), "ret").collect()
    assert {r.id for r in s} == set(range(6))
    assert all(r.target == returns[(r.id, r.mi)] and r.cap_prev == 1.0 + r.id for r in s)
    assert not any(r.id == 3 and 115 <= r.mi <= 127 for r in s)


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(2000).select("id", (F.col("id") % 7).cast("int").alias("mi"))
    a = {r.id for r in FT.with_split(df, 1).filter("is_validation").collect()}
    b = {r.id for r in FT.with_split(df.repartition(13), 1).filter("is_validation").collect()}
    assert a == b and 0.25 < len(a) / 2000 < 0.35
    assert a != {r.id for r in FT.with_split(df, 2).filter("is_validation").collect()}


def test_rescaled_weights_average_one(make):
    df = make([(1, 2.0, True), (2, 4.0, True), (3, 9.0, False)], "id long, weight double, is_train boolean")
    assert {r.id: r.fit_weight for r in FT.rescaled_weights(df).collect()} == {1: pytest.approx(2 / 3), 2: pytest.approx(4 / 3), 3: None}


def test_folds(make):
    df = make([(m,) for m in range(11) for _ in range(2)], "mi int")
    rows = {r.fold: (r.train_size, r.val_size) for r in FT.fold_sizes(df, 5).collect()}
    assert rows == {0: (4, 4), 1: (8, 4), 2: (12, 4), 3: (16, 4)}
