"""Linear ensembles from sufficient statistics.

A weighted linear fit needs only the moments of (1, features, target). They are added up once per
month and member; the training rows of any window, sub-period or fold are whole months, so its
fits are sums of month moments, and every fit is solved in array expressions. One pass over the
samples thus serves all windows and all members. A table of models has one row per model and
member; the ensemble's mean and spread follow from the mean and covariance of its coefficients,
so scoring is generated arithmetic without a column per member.

Weights inside a month do not depend on the window (up to a factor per window, which cancels).
The penalty ``RIDGE`` falls on the coefficients but not on the intercept, per unit of weight. A
model without training rows is absent. Rows with a missing feature, target or weight do not fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as C
from .crosssection import average_rank
from .evaluate import correlation_with_ranks, pooled_evaluation, rank_correlation
from .features import cv_folds, feature_names, is_validation, sample_weights, with_split
from .store import written

N_MEMBERS = 30
RIDGE = 1e-6
#: Smallest residual that an absolute-loss step divides by; targets are of order 0.01 to 1.
LEAST_RESIDUAL = 1e-6
#: An absolute-loss fit has settled when a step lowers its loss by less than this share.
SETTLED = 1e-4


def _pairs(k: int) -> list[tuple[int, int]]:
    """Index pairs of the upper triangle of (1, k features)."""
    return list(combinations_with_replacement(range(k + 1), 2))


def _vector(features: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(f"`{c}`") for c in features]]


# ---------------------------------------------------------------- moments


def training_rows(
    samples: DataFrame, weighting: str = "ewpm", n_members: int = N_MEMBERS, validation: float = K.VALIDATION_SHARE,
    seed: int = K.SEED, features: Sequence[str] | None = None, targets: Sequence[str] = ("target",),
) -> DataFrame:
    """One row per member and training row: mi, id, member, w, features, targets."""
    cols = list(features or feature_names())
    rows = sample_weights(samples, weighting, out="w").select("mi", "id", "w", *cols, *targets).dropna()
    members = F.explode(F.sequence(F.lit(0), F.lit(n_members - 1))).alias("member")
    rows = with_split(rows.select("*", members), F.col("member"), validation, seed)
    return rows.filter(~F.col("is_validation")).drop("is_validation")


def moments(rows: DataFrame, by: Sequence[str], features: Sequence[str] | None = None, targets: Sequence[str] = ("target",), weight: str = "w") -> DataFrame:
    """Weighted sums of products: ``m_i_j`` of (1, features), ``y_i_t`` of them with each target, and the number of rows."""
    z = _vector(features or feature_names())
    w = F.col(weight)
    sums = [F.sum(w * z[i] * z[j]).alias(f"m_{i}_{j}") for i, j in _pairs(len(z) - 1)]
    sums += [F.sum(w * z[i] * F.col(t)).alias(f"y_{i}_{n}") for n, t in enumerate(targets) for i in range(len(z))]
    return rows.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("n_rows"))


def summed(month_moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments of groups of months."""
    return month_moments.groupBy(*by).agg(*[F.sum(c).alias(c) for c in month_moments.columns if c[:2] in ("m_", "y_") or c in ("n_rows", "loss")])


def months_of(spark: SparkSession, periods: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(model, mi): the months of each period. A short table, whatever the data."""
    rows = [(name, C.period_index(a), C.period_index(b)) for name, a, b in periods]
    table = spark.createDataFrame(rows, "model string, lo int, hi int")
    return table.select("model", F.explode(F.sequence("lo", "hi")).alias("mi"))


# ---------------------------------------------------------------- solver


def reduced(rows: Column, k: int) -> Column:
    """Right sides of k equations after Gauss-Jordan steps; a row holds k coefficients and any number of right sides.

    Meant for positive definite matrices, whose pivots are positive in any order. A zero pivot gives NULLs.
    """

    def step(m: Column, p: Column) -> Column:
        of_pivot = lambda v: F.try_divide(v, F.get(F.get(m, p), p))
        unit = F.transform(F.get(m, p), of_pivot)
        return F.transform(m, lambda row, i: F.when(i == p, unit).otherwise(F.zip_with(row, unit, lambda a, u: a - F.get(row, p) * u)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), rows, step)
    return F.transform(done, lambda row: F.slice(row, k + 1, F.size(row) - k))


def eliminated(rows: Column, k: int) -> Column:
    """Solution of k equations with one right side."""
    return F.transform(reduced(rows, k), lambda row: F.get(row, F.lit(0)))


def coefficients(sums: DataFrame, by: Sequence[str], k: int, target: int = 0, ridge: float = RIDGE) -> DataFrame:
    """(by, coef, n_rows): intercept and slopes of each group of moments."""
    at = lambda i, j: F.col(f"m_{min(i, j)}_{max(i, j)}") / F.col("m_0_0")
    y = lambda i: F.col(f"y_{i}_{target}") / F.col("m_0_0")
    index = range(1, k + 1)
    system = F.array(*[
        F.array(*[at(i, j) - at(0, i) * at(0, j) + (ridge if i == j else 0.0) for j in index], y(i) - at(0, i) * y(0)) for i in index
    ])
    means = F.array(*[at(0, i) for i in index])
    # A table of models is small; written, each system is solved once.
    solved = written(
        sums.filter(F.col("m_0_0") > 0).select(*by, system.alias("system"), means.alias("means"), y(0).alias("mean_y"), "n_rows"), "systems"
    ).withColumn("slopes", eliminated(F.col("system"), k))
    dot = F.aggregate(F.zip_with("slopes", "means", lambda b, m: b * m), F.lit(0.0), lambda a, v: a + v)
    return written(solved.select(*by, F.concat(F.array(F.col("mean_y") - dot), "slopes").alias("coef"), "n_rows"), "coefficients")


# ---------------------------------------------------------------- fits


def fit_periods(
    samples: DataFrame, periods: Sequence[tuple[str, str, str]], weighting: str = "ewpm", n_members: int = N_MEMBERS,
    fitting_months_only: bool = True, validation: float = K.VALIDATION_SHARE, seed: int = K.SEED, features: Sequence[str] | None = None,
    ridge: float = RIDGE,
) -> DataFrame:
    """(model, member, coef, n_rows) of every period (name, first, last month), from one pass over the samples."""
    cols = list(features or feature_names())
    pool = samples.filter(C.is_fitting_month("mi")) if fitting_months_only else samples
    used = months_of(samples.sparkSession, periods)
    pool = pool.join(F.broadcast(used.select("mi").distinct()), "mi", "left_semi")
    monthly = written(moments(training_rows(pool, weighting, n_members, validation, seed, cols), ["mi", "member"], cols), "month-moments")
    return coefficients(summed(monthly.join(F.broadcast(used), "mi"), ["model", "member"]), ["model", "member"], len(cols), ridge=ridge)


def fit_windows(samples: DataFrame, start: str, windows: Sequence[tuple[str, str, str]] = K.EXPANDING_WINDOWS, **fit_args) -> DataFrame:
    """Expanding windows: all begin at ``start``; a window is named by its end."""
    return fit_periods(samples, [(window_name(end), start, end) for end, _, _ in windows], **fit_args)


def window_name(train_end: str) -> str:
    return f"window_{train_end.replace('-', '')}"


def fit_absolute(
    samples: DataFrame, periods: Sequence[tuple[str, str, str]], steps: int = 10, tolerance: float = 0.0, weighting: str = "ewpm",
    n_members: int = N_MEMBERS, fitting_months_only: bool = True, validation: float = K.VALIDATION_SHARE, seed: int = K.SEED,
    features: Sequence[str] | None = None, ridge: float = RIDGE,
) -> DataFrame:
    """Like ``fit_periods`` for the sum of absolute residuals, by iteratively reweighted least squares.

    The first step is the least-squares fit; each further one weighs a row by w / max(|residual|,
    LEAST_RESIDUAL). It stops after ``steps`` passes, or when no coefficient moved by more than
    ``tolerance``. One pass fits all periods and members; the rows carry their period, since
    residuals differ between models.
    """
    cols = list(features or feature_names())
    pool = samples.filter(C.is_fitting_month("mi")) if fitting_months_only else samples
    used = months_of(samples.sparkSession, periods)
    rows = training_rows(pool.join(F.broadcast(used.select("mi").distinct()), "mi", "left_semi"), weighting, n_members, validation, seed, cols)
    keys = ["model", "member"]
    rows = written(rows.join(F.broadcast(used), "mi"), "absolute-rows")
    coef = coefficients(moments(rows, keys, cols), keys, len(cols), ridge=ridge)
    for _ in range(steps - 1):
        gap = F.abs(F.col("target") - linear(F.col("coef"), cols))
        weighed = rows.join(coef.select(*keys, "coef"), keys).withColumn("w", F.col("w") / F.greatest(gap, F.lit(LEAST_RESIDUAL)))
        new = coefficients(moments(weighed, keys, cols), keys, len(cols), ridge=ridge)
        if tolerance > 0:
            moved = F.array_max(F.zip_with("coef", "old", lambda a, b: F.abs(a - b)))
            moved = new.join(coef.select(*keys, F.col("coef").alias("old")), keys).agg(F.max(moved)).first()[0]
            coef = new
            if moved is not None and moved <= tolerance:
                break
        coef = new
    return coef


# ---------------------------------------------------------------- scores


def linear(coef: Column, features: Sequence[str]) -> Column:
    """Intercept plus slopes times features, as generated arithmetic."""
    out = F.get(coef, F.lit(0))
    for i, c in enumerate(features, 1):
        out = out + F.get(coef, F.lit(i)) * F.col(f"`{c}`")
    return out


def ensembles(models: DataFrame, k: int, keys: Sequence[str] = ("model",)) -> DataFrame:
    """(keys, n_members, mean, cov): mean of the members' coefficients and upper triangle of their population covariance."""
    c = lambda i: F.get("coef", F.lit(i))
    return written(
        models.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_members"),
            F.array(*[F.avg(c(i)) for i in range(k + 1)]).alias("mean"),
            F.array(*[F.covar_pop(c(i), c(j)) for i, j in _pairs(k)]).alias("cov"),
        ),
        "ensembles",
    )


def _spread(features: Sequence[str]) -> Column:
    """Population standard deviation over members: the quadratic form of the covariance in (1, features)."""
    z = _vector(features)
    terms = [F.get("cov", F.lit(n)) * z[i] * z[j] * (1.0 if i == j else 2.0) for n, (i, j) in enumerate(_pairs(len(features)))]
    return F.sqrt(F.greatest(sum(terms[1:], terms[0]), F.lit(0.0)))


def _for_each(feats: DataFrame, table: DataFrame) -> DataFrame:
    """Every row once per row of a short table (models, not data), which travels as one array."""
    rows = table.agg(F.collect_list(F.struct(*table.columns)).alias("all")).scalar()
    return feats.select("*", F.inline(rows))


def score(models: DataFrame, feats: DataFrame, periods: Sequence[tuple[str, str, str]] | None = None, features: Sequence[str] | None = None,
          uncertainty: bool = False, keys: Sequence[str] = ("model",), carry: Sequence[str] = ()) -> DataFrame:
    """Ensemble forecasts (keys, mi, id, score[, uncertainty]).

    ``periods`` names the months of each model (default: every model on every month). The tables
    of models and months are short and fixed by the configuration; the features are read once.
    """
    cols = list(features or feature_names())
    table = ensembles(models, len(cols), keys)
    if periods is not None:
        table = table.join(months_of(feats.sparkSession, periods), "model")
        rows = feats.join(F.broadcast(table), "mi")
    else:
        rows = _for_each(feats, table)
    out = [linear(F.col("mean"), cols).alias("score"), *([_spread(cols).alias("uncertainty")] if uncertainty else [])]
    return rows.select(*keys, "mi", "id", *carry, *out)


def score_members(models: DataFrame, feats: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """One row per model and member: (model, member, mi, id, score)."""
    cols = list(features or feature_names())
    rows = _for_each(feats, models.select("model", "member", "coef"))
    return rows.select("model", "member", "mi", "id", linear(F.col("coef"), cols).alias("score"))


# ---------------------------------------------------------------- reports


def held_out_report(models: DataFrame, samples: DataFrame, periods: Sequence[tuple[str, str, str]], min_names: int = K.MIN_NAMES,
                    features: Sequence[str] | None = None, keys: Sequence[str] = ("model",), versus: Sequence[str] = ("excess_ret", "target")) -> DataFrame:
    """Mean monthly rank correlation of each model on its period's non-fitting months, against return and target."""
    rows = samples.filter(~C.is_fitting_month("mi"))
    scored = written(score(models, rows, periods, features, keys=keys, carry=versus), "held_out")
    out = None
    for name in versus:
        monthly = rank_correlation(scored, [*keys, "mi"], "score", name, min_names).filter(F.col("correlation").isNotNull())
        part = monthly.groupBy(*keys).agg(F.avg("correlation").alias("spearman"), F.count(F.lit(1)).alias("n_months"), F.sum("n").alias("n_rows"))
        part = part.select(*keys, F.lit(name).alias("versus"), "spearman", "n_months", "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def split_report(models: DataFrame, samples: DataFrame, period: tuple[str, str], fitting_months_only: bool = True,
                 validation: float = K.VALIDATION_SHARE, seed: int = K.SEED, features: Sequence[str] | None = None) -> DataFrame:
    """Spearman and mean squared error of the ensemble on both sides of member 0's split of the training months."""
    rows = samples.filter(C.in_period("mi", *period))
    if fitting_months_only:
        rows = rows.filter(C.is_fitting_month("mi"))
    rows = with_split(rows, 0, validation, seed)
    rows = rows.withColumn("split", F.when(F.col("is_validation"), "validation").otherwise("train"))
    scored = score(models, rows, features=features, carry=("split", "target"))
    return pooled_evaluation(scored, ["model", "split"], "score", "target").select(
        "model", "split", "spearman", "mse", F.col("n_observations").alias("n_rows")
    )


def cross_validate(samples: DataFrame, n_folds: int = 5, features: Sequence[str] | None = None, ridge: float = RIDGE) -> DataFrame:
    """Expanding folds of months: unweighted fits as sums of month moments, pooled Spearman on the next block."""
    cols = list(features or feature_names())
    roles = written(cv_folds(samples, n_folds), "folds")  # months times folds
    monthly = written(moments(samples.withColumn("w", F.lit(1.0)), ["mi"], cols), "month-moments")
    train = monthly.join(roles.filter(F.col("role") == "train"), "mi")
    models = coefficients(summed(train, ["fold"]), ["fold"], len(cols), ridge=ridge)
    blocks = roles.filter(F.col("role") == "validate").select("mi", "fold").join(models, "fold").select("mi", "fold", "coef")
    scored = samples.join(F.broadcast(blocks), "mi").select("fold", linear(F.col("coef"), cols).alias("score"), "target")
    return pooled_evaluation(scored, ["fold"], "score", "target").select(
        "fold", F.col("spearman").alias("spearman_corr"), F.col("n_observations").alias("val_size")
    )


# ---------------------------------------------------------------- the grid


def grid(samples_for, period: tuple[str, str], weightings: Sequence[str] = ("ew", "ewpm", "ewpmvw"),
         targets: Sequence[str] = ("ret", "ret_std", "ret_rank_norm", "ret_pctl"), losses: Sequence[str] = ("mse", "mae"), steps: int | None = None,
         n_members: int = N_MEMBERS, **fit_args) -> DataFrame:
    """Held-out rank correlation with the return of every linear configuration.

    All targets and weightings are columns of one table, and a task adds up the moments of all
    configurations, so that least squares takes a single pass; so does each step of reweighting for
    absolute loss, whose steps go on until every configuration's loss has settled, or to ``steps``
    fits if that is given. ``samples_for`` gives the samples of a target, or is one table with a column
    ``t_<target>`` for each.
    Output: loss, weighting, target, spearman, n_months.
    """
    targets = list(targets)
    if isinstance(samples_for, DataFrame):
        wide = samples_for
    else:
        wide = samples_for(targets[0]).withColumnRenamed("target", f"t_{targets[0]}")
        for kind in targets[1:]:
            wide = wide.join(samples_for(kind).select("mi", "id", F.col("target").alias(f"t_{kind}")), ["mi", "id"])
    wide = written(wide.filter(C.in_period("mi", *period)), "grid-samples")
    cols, names = feature_names(), [f"t_{k}" for k in targets]
    rows = grid_rows(wide.filter(C.is_fitting_month("mi")), weightings, n_members, cols, names, **fit_args)
    rows = written(rows, "grid-rows") if "mae" in losses else rows  # read in every step
    keys = ["loss", "weighting", "target", "member"]

    def fitted(coef: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        sums = written(grid_moments(rows, weightings, targets, n_members, cols, coef), "grid-moments")
        return coefficients(sums, keys[1:], len(cols)).select(*keys[1:], "coef"), sums

    coef, _ = fitted()
    found = coef.withColumn("loss", F.lit("mse")) if "mse" in losses else None
    if "mae" in losses:
        step, before = 1, {}
        while steps is None or step < steps:
            coef, sums = fitted(coef)
            step += 1
            # The loss of the fit before this step: a number per configuration and member.
            now = {tuple(r[:3]): r["loss"] for r in sums.select(*keys[1:], "loss").collect()}
            if steps is None and before and not any(before[c] - now[c] > SETTLED * before[c] for c in now):
                break
            before = now
        coef = coef.withColumn("loss", F.lit("mae"))
        found = coef if found is None else found.unionByName(coef)
    # The return is the same under every configuration, so it is ranked once, before the scores.
    held = written(average_rank(wide.filter(~C.is_fitting_month("mi")), ["mi"], "excess_ret", "_ry", "_n").drop("_n"), "grid-held")
    scored = score(found, held, keys=keys[:3], carry=("_ry",))
    monthly = correlation_with_ranks(scored, [*keys[:3], "mi"], "score", "_ry", K.MIN_NAMES).filter(F.col("correlation").isNotNull())
    return monthly.groupBy(*keys[:3]).agg(F.avg("correlation").alias("spearman"), F.count(F.lit(1)).alias("n_months"))


def grid_rows(pool: DataFrame, weightings: Sequence[str], n_members: int, cols: Sequence[str], names: Sequence[str],
              validation: float = K.VALIDATION_SHARE, seed: int = K.SEED) -> DataFrame:
    """One row per training row: ``w`` (a weight per weighting), ``train`` (a flag per member), ``x`` (features), ``y`` (targets)."""
    rows = pool
    for w in weightings:
        rows = sample_weights(rows, w, out=f"_w_{w}")
    weights = [f"_w_{w}" for w in weightings]
    rows = rows.select("mi", "id", *weights, *cols, *names).dropna()
    members = F.transform(F.sequence(F.lit(0), F.lit(n_members - 1)), lambda m: ~is_validation(m, validation, seed))
    doubles = lambda cs: F.array(*[F.col(f"`{c}`").cast("double") for c in cs])
    return rows.select(doubles(weights).alias("w"), members.alias("train"), doubles(cols).alias("x"), doubles(names).alias("y"))


def grid_moments(rows: DataFrame, weightings: Sequence[str], targets: Sequence[str], n_members: int, cols: Sequence[str],
                 coef: DataFrame | None = None) -> DataFrame:
    """Moments of every (weighting, target, member), as ``moments`` gives them for one target.

    A task keeps one sum per configuration and product and sends them once, whatever its number of
    rows, so no row is repeated or shuffled. With ``coef`` (a row per configuration) a row is weighed by
    w / max(|residual|, LEAST_RESIDUAL), and ``loss`` is the sum of w * |residual|.
    """
    k, pairs = len(cols), _pairs(len(cols))
    left, right = (list(side) for side in zip(*pairs))
    beta = None
    if coef is not None:
        of = {(r["weighting"], r["target"], r["member"]): r["coef"] for r in coef.select("weighting", "target", "member", "coef").collect()}
        # [target][feature, configuration]; a configuration without a fit keeps NaN, as its NULLs would
        lost = [float("nan")] * (k + 1)
        beta = [np.array([of.get((w, t, m)) or lost for w in weightings for m in range(n_members)], np.float64).T for t in targets]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(weightings) * n_members
        m = np.zeros((len(targets), c, len(pairs)))
        y = np.zeros((len(targets), c, k + 1))
        n, loss = np.zeros(n_members, np.int64), np.zeros((len(targets), c))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                column = lambda name, width: part.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)  # noqa: E731,B023
                train, ws = column("train", n_members).astype(np.float64), column("w", len(weightings))
                z = np.column_stack([np.ones(part.num_rows), column("x", k)])
                products, goals = z[:, left] * z[:, right], column("y", len(targets))
                w = (ws[:, :, None] * train[:, None, :]).reshape(-1, c)
                n += train.sum(0).astype(np.int64)
                same = w.T @ products if beta is None else None
                for t in range(len(targets)):
                    goal = goals[:, t : t + 1]
                    gap = None if beta is None else np.abs(goal - z @ beta[t])
                    own = w if gap is None else w / np.maximum(gap, LEAST_RESIDUAL)
                    loss[t] += 0 if gap is None else (w * gap).sum(0)
                    m[t] += own.T @ products if same is None else same
                    y[t] += own.T @ (z * goal)
        config = [(w, t, j) for t in range(len(targets)) for w in weightings for j in range(n_members)]
        columns = [pa.array([w for w, _, _ in config]), pa.array([targets[t] for _, t, _ in config]), pa.array([j for _, _, j in config], pa.int32())]
        columns += [pa.array(col) for col in (*m.reshape(-1, len(pairs)).T, *y.reshape(-1, k + 1).T)]
        columns += [pa.array([int(n[j]) for _, _, j in config], pa.int64()), pa.array(loss.ravel())]
        yield pa.RecordBatch.from_arrays(columns, schema.replace(" ", ",").split(",")[::2])

    sums = [*(f"m_{i}_{j}" for i, j in pairs), *(f"y_{i}_0" for i in range(k + 1))]
    schema = "weighting string,target string,member int," + ",".join(f"{s} double" for s in sums) + ",n_rows long,loss double"
    per_task = rows.mapInArrow(of_batches, schema)
    return summed(per_task, ["weighting", "target", "member"]).filter(F.col("n_rows") > 0)


# ---------------------------------------------------------------- storage

STORED = "model string, member int, coef array<double>, n_rows long, features array<string>"


def save_models(models: DataFrame, path: str, features: Sequence[str] | None = None) -> str:
    """All models as one table, with the feature names they expect."""
    names = F.array(*[F.lit(c) for c in features or feature_names()])
    models.select("model", F.col("member").cast("int"), "coef", "n_rows", names.alias("features")).write.mode("errorifexists").parquet(path)
    return path


def load_models(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> DataFrame:
    """The stored table; models of other features are refused."""
    cols = list(features or feature_names())
    rows = spark.read.schema(STORED).parquet(path)
    if not rows.filter(F.col("features") != F.array(*[F.lit(c) for c in cols])).isEmpty():
        raise ValueError(f"models at {path} were fitted on other features")
    return rows.drop("features")
