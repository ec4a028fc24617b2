"""Weighted ensembles on Spark ML, fitted per period and scored out of sample.

The members are Spark ML estimators; this module carries the contract around them: period and
fitting-month selection, sample weights, per-member validation split, ensemble mean and spread,
reports on held-out months, expanding windows, storage.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as C
from .evaluate import pooled_evaluation, rank_correlation
from .features import feature_names, fitting_flags, rescaled_weights, sample_weights, with_split
from .store import written

#: Jobs of independent fits that run side by side.
PARALLEL_FITS = 4

LEARNERS = ("linear", "gbt")
LOSSES = ("mse", "mae")
SCALINGS = ("standard", "minmax", "none")


# ---------------------------------------------------------------- scaling


@dataclass(frozen=True)
class Scaler:
    """Fitted shift and scale per feature; two numbers per feature on the driver."""

    method: str
    shift: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.shift[c]) / self.scale[c] for c in self.shift})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * self.scale[c] + self.shift[c] for c in self.shift})


def fit_scaler(samples: DataFrame, method: str = "standard", features: Sequence[str] | None = None) -> Scaler:
    """standard: mean and population std. minmax: to [0, 1]. A constant feature keeps scale 1."""
    if method not in SCALINGS:
        raise ValueError(f"unknown scaling {method!r}; one of {', '.join(SCALINGS)}")
    if method == "none":
        return Scaler("none")
    cols = list(features or feature_names())
    shift = F.avg if method == "standard" else F.min
    width = F.stddev_pop if method == "standard" else (lambda c: F.max(c) - F.min(c))
    row = samples.agg(
        *[shift(c).alias(f"a_{c}") for c in cols], *[width(c).alias(f"b_{c}") for c in cols]
    ).first()
    return Scaler(method, {c: row[f"a_{c}"] for c in cols}, {c: row[f"b_{c}"] or 1.0 for c in cols})


# ---------------------------------------------------------------- ensemble


@dataclass
class Ensemble:
    learner: str
    members: list
    features: list[str]
    scaler: Scaler
    config: dict = field(default_factory=dict)

    def _member_scores(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        scaled = self.scaler.transform(df)
        out = VectorAssembler(inputCols=self.features, outputCol="_x").transform(scaled)
        names = []
        for i, m in enumerate(self.members):
            name = f"_p{i}"
            out = m.copy().setPredictionCol(name).setFeaturesCol("_x").transform(out)
            names.append(name)
        return out, names

    def predict(self, df: DataFrame, uncertainty: bool = False) -> DataFrame:
        """(model keys, mi, id, score[, uncertainty]): mean and population std over members.

        Members add one column each, so the mean needs no shuffle.
        """
        scored, names = self._member_scores(df)
        keep = [c for c in df.columns if c not in self.features]
        cells = [F.col(n) for n in names]
        mean = sum(cells[1:], cells[0]) / len(cells)
        out = scored.withColumn("score", mean)
        if uncertainty:
            squares = [(c - F.col("score")) * (c - F.col("score")) for c in cells]
            out = out.withColumn("uncertainty", F.sqrt(sum(squares[1:], squares[0]) / len(cells)))
        return out.select(*keep, "score", *(["uncertainty"] if uncertainty else []))


def make_learner(kind: str = "gbt", loss: str = "mse", seed: int = K.SEED, **params):
    """A Spark ML regressor. Absolute loss exists for boosted trees only."""
    if kind not in LEARNERS or loss not in LOSSES:
        raise ValueError(f"learner {kind!r} / loss {loss!r} unknown")
    common = dict(featuresCol="_x", labelCol="target", weightCol="fit_weight")
    if kind == "linear":
        if loss != "mse":
            raise ValueError("the linear learner has no absolute loss")
        return LinearRegression(**common, **{"regParam": 1e-6, "standardization": False, **params})
    return GBTRegressor(
        **common,
        lossType="squared" if loss == "mse" else "absolute",
        validationIndicatorCol="is_validation",
        seed=seed,
        **{"maxIter": 20, "maxDepth": 3, "subsamplingRate": 0.8, "stepSize": 0.1, **params},
    )


def fit_ensemble(
    samples: DataFrame,
    period: tuple[str, str],
    learner: str = "gbt",
    loss: str = "mse",
    weighting: str = "ewpm",
    n_members: int = 30,
    scaling: str = "none",
    fitting_months_only: bool = True,
    validation: float = K.VALIDATION_SHARE,
    ordered_split: bool = False,
    seed: int = K.SEED,
    features: Sequence[str] | None = None,
    **params,
) -> Ensemble:
    """Fit ``n_members`` learners on one period, each with its own validation rows and seed."""
    cols = list(features or feature_names())
    pool = fitting_flags(samples, *period, fitting_months_only).filter("in_pool").drop("in_pool", "in_evaluation")
    pool = written(sample_weights(pool, weighting), "fit_pool")
    if pool.isEmpty():
        raise ValueError(f"no training rows in {period}")
    scaler = fit_scaler(pool, scaling, cols)
    base = VectorAssembler(inputCols=cols, outputCol="_x").transform(scaler.transform(pool))

    def member(i: int):
        rows = with_split(base, i, validation, seed, ordered_split).withColumn("is_train", ~F.col("is_validation"))
        rows = rescaled_weights(rows).withColumn("fit_weight", F.coalesce("fit_weight", F.lit(1.0)))
        rows = rows.select("_x", "target", "fit_weight", "is_validation")
        if learner == "linear":
            rows = rows.filter(~F.col("is_validation"))
        return make_learner(learner, loss, seed + i, **params).fit(rows)

    # Members are independent fits on the same written pool, so several jobs run side by side.
    with ThreadPoolExecutor(min(n_members, PARALLEL_FITS)) as fits:
        members = list(fits.map(member, range(n_members)))
    config = dict(
        learner=learner, loss=loss, weighting=weighting, period=list(period), scaling=scaling, seed=seed,
        fitting_months_only=fitting_months_only, validation=validation, n_members=n_members,
    )
    return Ensemble(learner, members, cols, scaler, config)


def score(ensemble: Ensemble, feats: DataFrame, period: tuple[str, str] | None = None, model: str = "ensemble", uncertainty: bool = False) -> DataFrame:
    """Forecasts of a period in long form."""
    src = feats.select("mi", "id", *ensemble.features)
    if period:
        src = src.filter(C.in_period("mi", *period))
    out = ensemble.predict(src, uncertainty)
    return out.select(F.lit(model).alias("model"), "mi", "id", "score", *(["uncertainty"] if uncertainty else []))


def score_members(ensemble: Ensemble, feats: DataFrame) -> DataFrame:
    """One row per member: (member, mi, id, score)."""
    scored, names = ensemble._member_scores(feats.select("mi", "id", *ensemble.features))
    cells = F.array(*[F.struct(F.lit(i).alias("member"), F.col(n).alias("score")) for i, n in enumerate(names)])
    return scored.select("mi", "id", F.inline(cells)).select("member", "mi", "id", "score")


def combine_members(scores: DataFrame) -> DataFrame:
    """Ensemble mean and population std of member forecasts stored in long form."""
    return scores.groupBy("mi", "id").agg(F.avg("score").alias("score"), F.stddev_pop("score").alias("uncertainty"))


def split_report(ensemble: Ensemble, samples: DataFrame) -> DataFrame:
    """Spearman and mean squared error on the training and validation rows of one fixed split."""
    c = ensemble.config
    pool = fitting_flags(samples, *c["period"], c["fitting_months_only"]).filter("in_pool")
    rows = with_split(pool.select("id", "mi", "target", *ensemble.features), 0, c["validation"], c["seed"])
    label = F.when(F.col("is_validation"), "validation").otherwise("train")
    scored = ensemble.predict(rows.withColumn("split", label))
    return pooled_evaluation(scored, ["split"], "score", "target").select(
        "split", "spearman", "mse", F.col("n_observations").alias("n_rows")
    )


def held_out_report(ensemble: Ensemble, samples: DataFrame, min_names: int = K.MIN_NAMES) -> DataFrame:
    """Mean monthly rank correlation on the period's non-fitting months, against target and return."""
    c = ensemble.config
    rows = fitting_flags(samples, *c["period"], c["fitting_months_only"]).filter("in_evaluation")
    scored = written(ensemble.predict(rows.select("id", "mi", "target", "excess_ret", *ensemble.features)), "held_out")
    parts = []
    for versus in ("excess_ret", "target"):
        monthly = rank_correlation(scored, ["mi"], "score", versus, min_names)
        parts.append(
            monthly.filter(F.col("correlation").isNotNull()).agg(
                F.lit(versus).alias("versus"), F.avg("correlation").alias("spearman"),
                F.count(F.lit(1)).alias("n_months"), F.sum("n").alias("n_rows"),
            )
        )
    return parts[0].unionByName(parts[1])


def expanding_forecasts(
    samples: DataFrame,
    feats: DataFrame,
    start: str,
    windows: Sequence[tuple[str, str, str]] = K.EXPANDING_WINDOWS,
    **fit_args,
) -> DataFrame:
    """Fit on [start, train_end] and forecast [forecast_start, forecast_end], window by window."""
    out = None
    for train_end, first, last in windows:
        e = fit_ensemble(samples, (start, train_end), **fit_args)
        part = score(e, feats, (first, last), f"window_{train_end.replace('-', '')}")
        out = part if out is None else out.unionByName(part)
    return out


def subperiod_forecasts(
    samples: DataFrame, feats: DataFrame, fits: Sequence[tuple[str, str, str]], period: tuple[str, str], **fit_args
) -> DataFrame:
    """Each model is fitted on all months of its own sub-period and scores the whole period."""
    out = None
    for label, start, end in fits:
        e = fit_ensemble(samples, (start, end), fitting_months_only=False, **fit_args)
        part = score(e, feats, period, label)
        out = part if out is None else out.unionByName(part)
    return out


def cross_validate(samples: DataFrame, n_folds: int = 5, learner: str = "linear", scaling: str = "standard", **params) -> DataFrame:
    """Expanding-window folds: one unweighted learner each, pooled Spearman on the next block."""
    from .features import cv_folds

    roles = written(cv_folds(samples, n_folds), "folds")
    cols = feature_names()
    parts = []
    for fold in range(n_folds - 1):
        at = lambda role: samples.join(
            roles.filter((F.col("fold") == fold) & (F.col("role") == role)).select("mi"), "mi", "left_semi"
        )
        train, val = at("train"), at("validate")
        scaler = fit_scaler(train, scaling, cols)
        rows = VectorAssembler(inputCols=cols, outputCol="_x").transform(scaler.transform(train))
        rows = rows.withColumn("fit_weight", F.lit(1.0)).withColumn("is_validation", F.lit(False))
        e = Ensemble(learner, [make_learner(learner, **params).fit(rows)], cols, scaler)
        scored = e.predict(val.select("target", *cols)).withColumn("fold", F.lit(fold))
        parts.append(scored)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return pooled_evaluation(out, ["fold"], "score", "target").select(
        "fold", F.col("spearman").alias("spearman_corr"), F.col("n_observations").alias("val_size")
    )


def grid_search(
    samples_for: Callable[[str], DataFrame],
    period: tuple[str, str],
    learners: Iterable[str] = LEARNERS,
    losses: Iterable[str] = LOSSES,
    weightings: Iterable[str] = ("ew", "ewpm", "ewpmvw"),
    targets: Iterable[str] = ("ret", "ret_std", "ret_rank_norm", "ret_pctl"),
    parallel: int = 4,
    **fit_args,
) -> DataFrame:
    """Held-out rank correlation of every configuration the learners support.

    Configurations run as concurrent Spark jobs; the driver holds one number for each.
    """
    targets = list(targets)
    tables = {t: samples_for(t) for t in targets}
    todo = [
        c for c in itertools.product(learners, losses, weightings, targets) if not (c[0] == "linear" and c[1] == "mae")
    ]

    def run(c):
        e = fit_ensemble(tables[c[3]], period, c[0], c[1], c[2], **fit_args)
        r = held_out_report(e, tables[c[3]]).filter(F.col("versus") == "excess_ret").first()
        return (*c, r["spearman"], r["n_months"])

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(run, todo))
    spark = tables[targets[0]].sparkSession
    return spark.createDataFrame(
        rows, "learner string, loss string, weighting string, target string, spearman double, n_months long"
    )


def best_configuration(results: DataFrame) -> DataFrame:
    names = ["learner", "loss", "weighting", "target"]
    best = results.agg(F.max_by(F.struct(*names, "spearman"), "spearman").alias("b"))
    return best.select("b.*")


# ---------------------------------------------------------------- model store


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save_ensemble(spark: SparkSession, ensemble: Ensemble, root: str, model_id: str, metrics: dict | None = None) -> str:
    path = f"{root.rstrip('/')}/{model_id}"
    for i, m in enumerate(ensemble.members):
        m.write().overwrite().save(f"{path}/member_{i}")
    meta = (
        model_id, ensemble.learner, len(ensemble.members), ensemble.features, ensemble.scaler.method,
        json.dumps([ensemble.scaler.shift, ensemble.scaler.scale]), json.dumps(ensemble.config), json.dumps(metrics or {}),
    )
    schema = (
        "model_id string, learner string, n_members int, features array<string>, scaling string, "
        "scaler string, config string, metrics string"
    )
    spark.createDataFrame([meta], schema).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return path


def load_ensemble(spark: SparkSession, path: str) -> tuple[str, Ensemble]:
    path = path.rstrip("/")
    fs, p = _fs(spark, f"{path}/metadata")
    if not fs.exists(p):
        raise FileNotFoundError(f"no model at {path}")
    m = spark.read.json(f"{path}/metadata").first()
    kind = {"linear": LinearRegressionModel, "gbt": GBTRegressionModel}[m["learner"]]
    members = [kind.load(f"{path}/member_{i}") for i in range(m["n_members"])]
    shift, scale = json.loads(m["scaler"])
    return m["model_id"], Ensemble(
        m["learner"], members, list(m["features"]), Scaler(m["scaling"], shift, scale), json.loads(m["config"])
    )


def list_models(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(
        "model_id string, learner string, n_members int, scaling string, config string, metrics string"
    ).json(f"{root.rstrip('/')}/*/metadata")


def delete_model(spark: SparkSession, root: str, model_id: str) -> bool:
    fs, p = _fs(spark, f"{root.rstrip('/')}/{model_id}")
    return bool(fs.delete(p, True)) if fs.exists(p) else False
