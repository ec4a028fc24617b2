import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelloom.functions import calendar as C
from panelloom.operators import evaluate as E
from panelloom.operators import features as FT
from panelloom.operators import learn as L
from panelloom.operators import moments as M
from panelloom.operators.crosssection import average_rank
from panelloom.operators.features import feature_names, rescaled_weights, sample_weights, with_split
from panelloom.operators.store import new_path, written
from panelloom.plans import queries as Q
from panelloom.plans.registry import QUERIES


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(1)
    rows = []
    for m in range(24000, 24036):
        for i in range(20):
            x = rng.normal(size=12)
            y = 0.8 * x[0] - 0.4 * x[5] + 0.1 + rng.standard_t(2) * 0.1
            rows.append((i, m, *map(float, x), float(y), float(y) * 2, None if i == 3 else 1.0 + i))
    cols = ["id", "mi", *feature_names(), "target", "excess_ret", "cap_prev"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'id' else 'int' if c == 'mi' else 'double'}" for c in cols))
    return written(df, "train")


def test_elimination_solves(spark):
    rng = np.random.default_rng(2)
    for k in (1, 2, 5, 12):
        a = rng.normal(size=(k + 3, k))
        m, y = a.T @ a, rng.normal(size=k)
        rows = np.column_stack([m, y]).tolist()
        got = spark.createDataFrame([(rows,)], "m array<array<double>>").select(M.eliminated(F.col("m"), k).alias("x")).first().x
        assert np.allclose(got, np.linalg.solve(m, y))
    assert spark.createDataFrame([([[0.0, 1.0]],)], "m array<array<double>>").select(M.eliminated(F.col("m"), 1).alias("x")).first().x == [None]


@pytest.mark.parametrize("weighting", ["ew", "ewpm", "ewpmvw"])
def test_members_equal_the_library_fits(samples, weighting):
    models = {r.member: r.coef for r in M.fit_periods(samples, [("a", "2000-01", "2001-12")], weighting, n_members=3).collect()}
    pool = samples.filter((F.col("mi") < 24024) & (F.floor(F.col("mi") / 12) % 2 == (F.col("mi") % 12 + 1) % 2))
    pool = sample_weights(pool, weighting)
    for member in range(3):
        rows = rescaled_weights(with_split(pool, member).withColumn("is_train", ~F.col("is_validation"))).filter("is_train")
        rows = VectorAssembler(inputCols=feature_names(), outputCol="_x").transform(rows)
        fit = LinearRegression(featuresCol="_x", labelCol="target", weightCol="fit_weight", regParam=1e-6, standardization=False, solver="normal").fit(rows)
        assert np.allclose(models[member], [fit.intercept, *fit.coefficients], atol=1e-8)


def test_windows_take_one_pass_and_equal_separate_fits(samples):
    windows = (("2000-12", "2001-01", "2001-12"), ("2001-12", "2002-01", "2002-12"))
    together = {(r.model, r.member): r.coef for r in M.fit_windows(samples, "2000-01", windows, n_members=2).collect()}
    for end, _, _ in windows:
        alone = M.fit_periods(samples, [(M.window_name(end), "2000-01", end)], n_members=2).collect()
        for r in alone:
            assert np.allclose(together[r.model, r.member], r.coef)
    assert len(together) == 4


def test_scores_equal_the_members(samples):
    models = M.fit_periods(samples, [("a", "2000-01", "2001-12"), ("b", "2001-01", "2002-12")], n_members=7)
    wide = {(r.model, r.mi, r.id): (r.score, r.uncertainty) for r in M.score(models, samples, uncertainty=True).collect()}
    members = M.score_members(models, samples).groupBy("model", "mi", "id").agg(F.avg("score").alias("score"), F.stddev_pop("score").alias("u")).collect()
    assert len(members) == len(wide) == 2 * 720
    for r in members:
        assert wide[r.model, r.mi, r.id] == pytest.approx((r.score, r.u), abs=1e-9)
    months = M.score(models, samples, [("a", "2002-01", "2002-02"), ("b", "2002-02", "2002-02")]).collect()
    assert len(months) == 60 and all(wide[r.model, r.mi, r.id][0] == pytest.approx(r.score) for r in months)


def test_absolute_loss_takes_the_stated_steps_towards_the_median_fit(samples):
    got = M.fit_absolute(
        samples, [("a", "2000-01", "2002-12")], steps=6, weighting="ew", n_members=1, fitting_months_only=False, validation=0.0
    ).first().coef
    rows = samples.select(*feature_names(), "target").toPandas()
    x, y = np.column_stack([np.ones(len(rows)), rows[feature_names()]]), rows["target"].to_numpy()
    penalty = M.RIDGE * np.diag([0.0] + [1.0] * 12)
    loss = lambda b: np.abs(y - x @ b).mean()

    def reweighted(steps):
        w = np.ones(len(y)) / len(y)
        for _ in range(steps):
            b = np.linalg.solve((x.T * w) @ x / w.sum() + penalty, (x.T * w) @ y / w.sum())
            w = 1 / len(y) / np.maximum(np.abs(y - x @ b), M.LEAST_RESIDUAL)
        return b

    assert np.allclose(got, reweighted(6), atol=1e-7)
    best = loss(reweighted(2000))
    assert best <= loss(np.array(got)) < best * 1.005 < loss(reweighted(1))


def test_steps_and_stop_rule_on_an_intercept(spark):
    rows = [(k, 24000, 0.0, float(v), 1.0) for k, v in enumerate([1, 2, 3, 10, 100])]
    df = written(spark.createDataFrame(rows, "id long, mi int, cr1 double, target double, cap_prev double"), "five")
    fit = lambda **kw: M.fit_absolute(df, [("a", "2000-01", "2000-01")], weighting="ew", n_members=1, fitting_months_only=False, validation=0.0, features=["cr1"], **kw).first().coef[0]
    # weighted means by hand: 23.2, 10.1847, 9.6670, ...
    assert fit(steps=1) == pytest.approx(23.2)
    assert fit(steps=20, tolerance=1.0) == pytest.approx(9.667038191)  # the third step moves by 0.52


def test_storage(spark, samples):
    models = M.fit_periods(samples, [("a", "2000-01", "2001-12")], n_members=2)
    path = M.save_models(models, new_path(spark, "models"))
    assert sorted(M.load_models(spark, path).collect()) == sorted(models.withColumn("member", F.col("member").cast("int")).collect())
    with pytest.raises(ValueError):
        M.load_models(spark, path, ["cr1"])


def test_folds_and_reports(samples):
    folds = {r.fold: r for r in M.cross_validate(samples, 4).collect()}
    old = {r.fold: r for r in L.cross_validate(samples, 4).collect()}
    assert {f: (round(r.spearman_corr, 5), r.val_size) for f, r in folds.items()} == {f: (round(r.spearman_corr, 5), r.val_size) for f, r in old.items()}
    models = M.fit_periods(samples, [("a", "2000-01", "2001-12")], n_members=3)
    held = {r.versus: r for r in M.held_out_report(models, samples, [("a", "2000-01", "2001-12")]).collect()}
    assert held["target"].n_months == held["excess_ret"].n_months == 12 and held["target"].spearman > 0.8
    parts = {r.split: r for r in M.split_report(models, samples, ("2000-01", "2001-12")).collect()}
    assert parts["train"].n_rows + parts["validation"].n_rows == 12 * 20


def test_periods_without_rows_have_no_model(samples):
    got = M.fit_periods(samples, [("none", "1980-01", "1980-12"), ("a", "2000-01", "2001-12")], n_members=1).collect()
    assert [r.model for r in got] == ["a"]


def test_the_grid_covers_every_linear_configuration(samples):
    kinds = {"ret": 1.0, "ret_pctl": -1.0}
    out = M.grid(lambda k: samples.withColumn("target", F.col("target") * kinds[k]), ("2000-01", "2001-12"), targets=list(kinds), steps=3, n_members=2).collect()
    assert len(out) == 2 * 3 * 2 and all(abs(r.spearman) > 0.8 and (r.spearman > 0) == (r.target == "ret") for r in out)


def test_grid_keeps_one_row_per_training_row_and_the_same_moments(samples):
    kinds = ["ret", "ret_pctl"]
    pool = samples.withColumns({"t_ret": F.col("target"), "t_ret_pctl": F.col("target") - 2 * F.col("cr3")})
    cols, names = feature_names(), [f"t_{k}" for k in kinds]
    rows = M.grid_rows(pool, ("ew", "ewpmvw"), 3, cols, names)
    assert rows.count() == pool.count()
    rows = rows.repartition(3)
    got = M.grid_moments(rows, ("ew", "ewpmvw"), kinds, 3, cols)
    fits = M.coefficients(got, ["weighting", "target", "member"], 12)
    again = M.grid_moments(rows, ("ew", "ewpmvw"), kinds, 3, cols, fits)
    bound = {(r.weighting, r.target, r.member): (r, s) for r in got.collect() for s in again.collect() if (r.weighting, r.target, r.member) == (s.weighting, s.target, s.member)}
    assert len(bound) == 12
    coef = fits.select("weighting", "target", "member", "coef")
    for weighting in ("ew", "ewpmvw"):
        train = M.training_rows(pool, weighting, 3, targets=names)
        for n, kind in enumerate(kinds):
            want = {r.member: r for r in M.moments(train, ["member"], cols, [names[n]]).collect()}
            own = train.join(coef.filter((F.col("weighting") == weighting) & (F.col("target") == kind)), "member")
            own = own.withColumn("w", F.col("w") / F.greatest(F.abs(F.col(names[n]) - M.linear(F.col("coef"), cols)), F.lit(M.LEAST_RESIDUAL)))
            steps = {r.member: r for r in M.moments(own, ["member"], cols, [names[n]]).collect()}
            for member in range(3):
                for have, right in zip(bound[weighting, kind, member], (want[member], steps[member])):
                    assert have.n_rows == right.n_rows
                    assert all(have[c] == pytest.approx(right[c], rel=1e-7, abs=1e-9) for c in right.asDict() if c[:2] in ("m_", "y_"))


def test_samples_of_targets_equal_the_samples_of_each(spark):
    rng = np.random.default_rng(3)
    rows = [(i, m, None, float(rng.integers(1, 4)), float(rng.integers(-3, 4)) / 10) for i in range(6) for m in range(24000, 24030)]
    panel = written(spark.createDataFrame(rows, "id long, mi int, date date, mcap double, ret double"), "panel")
    kinds, period = ["ret", "ret_std", "ret_rank_norm", "ret_pctl"], ("2001-03", "2001-12")
    got = {(r.id, r.mi): r for r in FT.samples_of_targets(panel, kinds, period).collect()}
    for kind in kinds:
        want = [r for r in FT.feature_samples(panel, kind).collect() if 24014 <= r.mi <= 24023]
        assert len(want) == len(got) == 60
        for r in want:
            o = got[r.id, r.mi]
            assert (o[f"t_{kind}"], o.excess_ret, o.cap_prev, o.cr12) == (r.target, r.excess_ret, r.cap_prev, r.cr12)


def test_correlation_with_given_ranks(spark):
    rng = np.random.default_rng(4)
    rows = [(g, k, None if k == 7 else 1.0 if g == "flat" else float(rng.integers(0, 40)), float(rng.integers(0, 30))) for g in ("a", "b", "flat") for k in range(500)]
    df = written(spark.createDataFrame(rows, "g string, id long, x double, y double"), "pairs")
    want = {r.g: r for r in E.rank_correlation(df, ["g"], "x", "y").collect()}
    ranked = average_rank(df.filter("x IS NOT NULL"), ["g"], "y", "ry", "n").drop("n")
    got = {r.g: r for r in E.correlation_with_ranks(ranked, ["g"], "x", "ry").collect()}
    assert got["flat"].correlation is None and want["flat"].correlation is None
    assert {g: r.n for g, r in got.items()} == {g: 499 for g in want}
    assert all(got[g].correlation == pytest.approx(want[g].correlation, abs=1e-12) for g in "ab")


def test_absolute_loss_in_the_grid_goes_on_until_it_settles(samples, monkeypatch):
    """Only the last step no longer lowers the loss, which is near that of the best fit."""
    written_sums, losses = M.written, []

    def spy(df, label, *args):
        out = written_sums(df, label, *args)
        if label == "grid-moments":
            losses.append(out.first()["loss"])
        return out

    monkeypatch.setattr(M, "written", spy)
    monkeypatch.setattr(M, "SETTLED", 2e-3)  # fewer steps
    out = M.grid(lambda _: samples, ("2000-01", "2002-12"), ("ew",), ["ret"], ("mae",), n_members=1, validation=0.0).collect()
    assert [(r.loss, r.weighting, r.target) for r in out] == [("mae", "ew", "ret")]
    rows = samples.filter(C.is_fitting_month("mi")).select(*feature_names(), "target", "cap_prev").toPandas()
    x, y = np.column_stack([np.ones(len(rows)), rows[feature_names()]]), rows["target"].to_numpy()
    w = np.ones(len(y))
    for _ in range(3000):
        b = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        w = 1 / np.maximum(np.abs(y - x @ b), 1e-9)
    best = losses[1] / np.abs(y - x @ np.linalg.lstsq(x, y, rcond=None)[0]).mean() * np.abs(y - x @ b).mean()
    assert losses[0] == 0 and all(a >= c * (1 - 1e-9) for a, c in zip(losses[1:], losses[2:]))
    assert losses[-2] - losses[-1] <= M.SETTLED * losses[-2] and all(a - c > M.SETTLED * a for a, c in zip(losses[1:-2], losses[2:-1]))
    assert best * (1 - 1e-6) < losses[-1] < best * 1.02


def test_the_absolute_loss_query_names_no_number_of_steps(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(Q.ML, "grid", lambda *args, **options: seen.update(options) or spark.range(1))
    QUERIES["absolute_loss_grid"](spark, "/root/testdata/sf0.001")
    assert seen["losses"] == ("mae",) and "steps" not in seen
