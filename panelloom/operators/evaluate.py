"""Forecast quality and data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as C
from . import crosssection as X
from .sorts import MONTH, clean_scores
from .store import written


def matched(scores: DataFrame, returns: DataFrame) -> DataFrame:
    """Scores and returns of the same security and month, both present."""
    r = returns.filter(F.col("ret").isNotNull()).select("mi", "id", "ret")
    return clean_scores(scores).join(r, ["mi", "id"])


def rank_correlation(rows: DataFrame, by: Sequence[str], x: str, y: str, min_rows: int = 2) -> DataFrame:
    """Spearman correlation per group with average ranks: (by, correlation, n).

    Groups below ``min_rows`` are left out; a constant side gives NULL. Every row is numbered when
    the pairs are written, so that equal pairs (zero returns under a constant score) are told apart
    and spread over tasks.
    """
    pairs = rows.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).dropna(subset=["_x", "_y"])
    pairs = written(pairs.withColumn("_row", F.monotonically_increasing_id()), "pairs")
    ranked = X.average_rank(pairs, by, "_x", "_rx", "_n").drop("_n")
    ranked = X.average_rank(written(ranked, "ranked"), by, "_y", "_ry", "_n")
    return (
        ranked.groupBy(*by)
        .agg(X.correlation("_rx", "_ry").alias("correlation"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_rows)
    )


def correlation_with_ranks(rows: DataFrame, by: Sequence[str], x: str, ry: str, min_rows: int = 2) -> DataFrame:
    """Correlation of the average ranks of ``x`` with ranks ``ry`` that the rows carry already: (by, correlation, n).

    Equal values share their rank, so a value needs only its count and its sums of ``ry``. Values are
    ranked inside range-partitioned chunks; the sums of a chunk then take the number of rows before it,
    so no row is joined back.
    """
    given = rows.filter(F.col(x).isNotNull() & F.col(ry).isNotNull())
    r = F.col(ry).cast("double")
    values = given.groupBy(*by, F.col(x).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.sum(r).alias("_y"), F.sum(r * r).alias("_yy"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(values.repartitionByRange(parts, *by, "_v").withColumn("_part", F.spark_partition_id()), "chunks")
    inside = F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v")) - (F.col("_c") - 1) / 2
    c, w = F.col("_c").cast("double"), F.col("_w")
    chunks = placed.withColumn("_w", inside).groupBy(*by, "_part").agg(
        F.sum("_c").alias("_in"), F.sum(c * w).alias("_sw"), F.sum(c * w * w).alias("_sww"), F.sum(w * F.col("_y")).alias("_swy"),
        F.sum("_y").alias("_sy"), F.sum("_yy").alias("_syy"),
    )
    lower = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    before, n = F.coalesce(F.sum("_in").over(lower), F.lit(0)).cast("double"), F.sum("_in")
    b = F.col("_b")
    sx = F.sum(F.col("_sw") + b * F.col("_in"))
    sxx = F.sum(F.col("_sww") + 2 * b * F.col("_sw") + b * b * F.col("_in"))
    sxy = F.sum(F.col("_swy") + b * F.col("_sy"))
    sy, syy = F.sum("_sy"), F.sum("_syy")
    # One differing rank moves the variance by about 1 / n of the square; less is rounding, and the side is constant.
    root = lambda total, square: F.sqrt(F.when(total - square > 1e-12 * total, total - square).otherwise(0.0))
    spread = root(n * sxx, sx * sx) * root(n * syy, sy * sy)
    out = chunks.withColumn("_b", before).groupBy(*by).agg(F.try_divide(n * sxy - sx * sy, spread).alias("correlation"), n.alias("n"))
    return out.filter(F.col("n") >= min_rows)


def monthly_spearman(scores: DataFrame, returns: DataFrame, min_names: int = K.MIN_NAMES) -> DataFrame:
    out = rank_correlation(matched(scores, returns), MONTH, "score", "ret", min_names)
    return out.select(*MONTH, C.month_end("mi").alias("date"), "correlation", "n")


def ic_summary(monthly: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, population std, ratio and share of positive months of the monthly correlations."""
    std = F.stddev_pop("correlation")
    return monthly.filter(F.col("correlation").isNotNull()).groupBy(*keys).agg(
        F.avg("correlation").alias("mean_ic"),
        std.alias("std_ic"),
        F.when(std > 0, F.avg("correlation") / std).otherwise(0.0).alias("ir"),
        F.avg(F.when(F.col("correlation") > 0, 1.0).otherwise(0.0)).alias("positive_ic_pct"),
        F.count(F.lit(1)).alias("n_months"),
    )


def pooled_evaluation(
    rows: DataFrame, keys: Sequence[str] = ("model",), x: str = "score", y: str = "ret"
) -> DataFrame:
    """Spearman, Pearson, mean squared and absolute error over all observations of a key."""
    rows = written(rows.select(*keys, x, y).dropna(), "pooled")
    rank = rank_correlation(rows, keys, x, y, 2).select(*keys, F.col("correlation").alias("spearman"))
    gap = F.col(x) - F.col(y)
    rest = rows.groupBy(*keys).agg(
        X.correlation(x, y).alias("pearson"),
        F.avg(gap * gap).alias("mse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.count(F.lit(1)).alias("n_observations"),
    )
    return rest.join(rank, list(keys), "left").select(
        *keys, "spearman", "pearson", "mse", "mae", "n_observations"
    )


# ---------------------------------------------------------------- reports


def _distinct(df: DataFrame, column: str) -> Column:
    return df.agg(F.countDistinct(column).alias("n")).scalar()


def forecast_overview(scores: DataFrame) -> DataFrame:
    """Shape and distribution of each model's forecasts over its months x securities grid."""
    s = clean_scores(scores)
    per_model = s.groupBy("model").agg(
        F.countDistinct("mi").alias("n_months"),
        F.countDistinct("id").alias("n_ids"),
        F.count(F.lit(1)).alias("_n"),
        F.avg("score").alias("pred_mean"),
        F.stddev_samp("score").alias("pred_std"),
        F.min("score").alias("pred_min"),
        F.max("score").alias("pred_max"),
    )
    cells = F.col("n_months") * F.col("n_ids")
    return per_model.select(
        "model", "n_months", "n_ids", (cells - F.col("_n")).alias("n_null"),
        ((cells - F.col("_n")) / cells).alias("null_fraction"), "pred_mean", "pred_std", "pred_min", "pred_max",
    )


def forecast_by_month(scores: DataFrame) -> DataFrame:
    """Cross-sectional mean, sample std and share of missing forecasts per month."""
    s = clean_scores(scores)
    ids = written(s.groupBy("model").agg(F.countDistinct("id").alias("_ids")), "model_ids")
    months = s.groupBy(*MONTH).agg(
        F.avg("score").alias("cs_mean"), F.stddev_samp("score").alias("cs_std"), F.count(F.lit(1)).alias("_n")
    )
    return months.join(ids, "model").select(
        *MONTH, C.month_end("mi").alias("date"), "cs_mean", "cs_std", (1 - F.col("_n") / F.col("_ids")).alias("cs_null_frac")
    )


def head_and_tail(by_month: DataFrame, n: int = 6) -> DataFrame:
    """First and last ``n`` months of each model. One row per month, so windows are bounded."""
    w = Window.partitionBy("model")
    return (
        by_month.withColumn("_a", F.row_number().over(w.orderBy("mi")))
        .withColumn("_z", F.row_number().over(w.orderBy(F.col("mi").desc())))
        .filter((F.col("_a") <= n) | (F.col("_z") <= n))
        .drop("_a", "_z")
    )


def panel_overview(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("mi").alias("n_months"),
        F.countDistinct("id").alias("n_ids"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
    )


def missing_by_security(panel: DataFrame, max_missing: float = K.MAX_MISSING_SHARE) -> DataFrame:
    """Share of the panel's months without a return, per security."""
    share = 1 - F.col("_n") / _distinct(panel, "mi")
    return (
        panel.groupBy("id")
        .agg(F.count("ret").alias("_n"))
        .select("id", share.alias("missing_pct"))
        .withColumn("high_missing", F.col("missing_pct") > max_missing)
    )


def quality_report(
    panel: DataFrame,
    max_missing: float = K.MAX_MISSING_SHARE,
    threshold: float = K.OUTLIER_Z,
    max_outliers: float = K.MAX_OUTLIER_SHARE,
) -> DataFrame:
    """One row: missing and outlier shares, date span, sizes, and the two warnings."""
    missing = missing_by_security(panel, max_missing).agg(
        F.avg("missing_pct").alias("missing_pct"),
        F.count(F.when(F.col("high_missing"), 1)).alias("n_high_missing"),
        F.count(F.lit(1)).alias("n_ids"),
    )
    stats = written(panel.agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s")), "pooled_moments")
    z = F.abs(F.try_divide(F.col("ret") - stats.select("m").scalar(), stats.select("s").scalar()))
    rows = panel.agg(
        F.avg(F.when(F.col("ret").isNotNull(), F.when(z > threshold, 1.0).otherwise(0.0))).alias("outlier_pct"),
        F.datediff(F.max("date"), F.min("date")).alias("date_range_days"),
        F.countDistinct("mi").alias("n_months"),
    )
    both = missing.withColumn("_k", F.lit(1)).join(rows.withColumn("_k", F.lit(1)), "_k")
    return both.select(
        "missing_pct", "n_high_missing", "outlier_pct", "date_range_days", "n_ids", "n_months",
        (F.col("n_high_missing") > 0).alias("missing_warning"),
        (F.col("outlier_pct") > max_outliers).alias("outlier_warning"),
    )
