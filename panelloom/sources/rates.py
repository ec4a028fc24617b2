"""Risk-free rates and factor returns from local files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import calendar as C


def parse_risk_free(lines: DataFrame) -> DataFrame:
    """Rates from the library's text table: rows that start with YYYYMM, field 5 in percent."""
    text = F.trim("value")
    fields = F.split(text, ",")
    rows = lines.filter(text.rlike(r"^\d{6},") & (F.size(fields) >= 5))
    ym = F.trim(fields[0]).cast("int")
    return rows.select(
        ym.alias("ym"),
        C.index_of_ym(ym).alias("mi"),
        C.first_of_ym(ym).alias("date"),
        (F.trim(fields[4]).try_cast(T.DoubleType()) / 100).alias("rate"),
    )


def read_risk_free(spark: SparkSession, path: str) -> DataFrame:
    """Text table, or Parquet with (ym, rate)."""
    if path.rstrip("/").lower().endswith(".parquet"):
        return spark.read.parquet(path).select(
            "ym", C.index_of_ym("ym").alias("mi"), C.first_of_ym("ym").alias("date"), "rate"
        )
    return parse_risk_free(spark.read.text(path))


def load_factors(factors: DataFrame, model: str, start: str, end: str) -> DataFrame:
    """Factor returns of one model and period."""
    if model not in K.FACTOR_MODELS:
        raise ValueError(f"unknown factor model {model!r}; available: {', '.join(K.FACTOR_MODELS)}")
    return factors.select("mi", *[F.col(f"`{f}`") for f in K.FACTOR_MODELS[model]]).filter(C.in_period("mi", start, end))
