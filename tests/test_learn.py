import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import evaluate as E
from panelloom.operators import learn as L
from panelloom.operators.features import feature_names
from panelloom.operators.store import new_path, written


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(1)
    rows = []
    for m in range(24000, 24024):
        for i in range(25):
            x = rng.normal(size=12)
            y = 0.8 * x[0] - 0.4 * x[5] + rng.normal() * 0.1
            rows.append((i, m, *map(float, x), float(y), float(y), 1.0 + i))
    cols = ["id", "mi", *feature_names(), "target", "excess_ret", "cap_prev"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'id' else 'int' if c == 'mi' else 'double'}" for c in cols))
    return written(df, "train")


def test_scaler_round_trip(samples):
    for method in ("standard", "minmax", "none"):
        s = L.fit_scaler(samples, method)
        back = s.inverse(s.transform(samples)).orderBy("mi", "id").first()
        assert back.cr1 == pytest.approx(samples.orderBy("mi", "id").first().cr1)
    z = L.fit_scaler(samples).transform(samples).agg(F.avg("cr3").alias("m"), F.stddev_pop("cr3").alias("s")).first()
    assert z.m == pytest.approx(0, abs=1e-9) and z.s == pytest.approx(1)


def test_linear_ensemble_learns_and_survives_storage(spark, samples):
    e = L.fit_ensemble(samples, ("2000-01", "2001-06"), "linear", n_members=2, scaling="standard")
    out = L.score(e, samples, ("2001-07", "2001-12"), "m", uncertainty=True)
    assert out.count() == 6 * 25
    ic = E.monthly_spearman(out.drop("uncertainty"), samples.withColumnRenamed("excess_ret", "ret")).agg(F.avg("correlation")).first()[0]
    assert ic > 0.9
    root = new_path(spark, "models")
    path = L.save_ensemble(spark, e, root, "one", {"ic": ic})
    name, back = L.load_ensemble(spark, path)
    assert name == "one"
    a = {(r.mi, r.id): r.score for r in out.collect()}
    b = {(r.mi, r.id): r.score for r in L.score(back, samples, ("2001-07", "2001-12")).collect()}
    assert a == pytest.approx(b)
    assert [r.model_id for r in L.list_models(spark, root).collect()] == ["one"]
    assert L.delete_model(spark, root, "one") and not L.delete_model(spark, root, "one")
    with pytest.raises(FileNotFoundError):
        L.load_ensemble(spark, path)


def test_reports_and_member_mean(samples):
    e = L.fit_ensemble(samples, ("2000-01", "2001-12"), "linear", n_members=2)
    report = {r.split: r for r in L.split_report(e, samples).collect()}
    assert report["train"].spearman > 0.9 and report["train"].n_rows + report["validation"].n_rows == 12 * 25
    held = {r.versus: r for r in L.held_out_report(e, samples).collect()}
    assert held["target"].n_months == 12 and held["target"].spearman > 0.9
    long = {(r.mi, r.id): (r.score, r.uncertainty) for r in L.combine_members(L.score_members(e, samples)).collect()}
    wide = {(r.mi, r.id): (r.score, r.uncertainty) for r in L.score(e, samples, uncertainty=True).collect()}
    assert all(long[k] == pytest.approx(wide[k], abs=1e-12) for k in wide)


def test_boosted_trees_use_both_losses(samples):
    for loss in L.LOSSES:
        e = L.fit_ensemble(samples, ("2000-01", "2001-06"), "gbt", loss, n_members=1, maxIter=2)
        assert L.score(e, samples, ("2001-07", "2001-12")).count() == 150
    with pytest.raises(ValueError):
        L.make_learner("linear", "mae")
    with pytest.raises(ValueError):
        L.fit_ensemble(samples, ("1980-01", "1981-01"), "linear", n_members=1)
