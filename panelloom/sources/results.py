"""Forecast files, run metadata, result writers, keyed dataset store."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as C
from ..functions.scalars import nan_to_null


def long_forecasts(wide: DataFrame, model: str = "score") -> DataFrame:
    """Wide forecast table (date + one column per security) to (model, mi, id, score)."""
    ids = [c for c in wide.columns if c != "date"]
    if not ids:
        raise ValueError("no security columns")
    typed = wide.select(F.col("date").cast("date").alias("date"), *[F.col(f"`{c}`").cast("double") for c in ids])
    return (
        typed.unpivot("date", [f"`{c}`" for c in ids], "id", "score")
        .select(F.lit(model).alias("model"), C.month_index("date").alias("mi"), "id", nan_to_null("score").alias("score"))
        .filter(F.col("score").isNotNull())
    )


def wide_forecasts(scores: DataFrame, ids: Sequence) -> DataFrame:
    """Export of one model: a date and one column for each of the named securities."""
    return scores.groupBy(C.month_end("mi").alias("date")).pivot("id", list(ids)).agg(F.first("score"))


#: Ids that share a row of a wide table in blocks, about.
BLOCK_IDS = 10_000


def wide_blocks(rows: DataFrame, value: str, by: str = "date", ids: int | None = None) -> DataFrame:
    """Wide table for any number of ids: (block, by, values), one map from id to value per date and block of ids.

    Ids fall into blocks by hash, as many blocks as keep about ``ids`` ids in each, so a row is bounded
    and no id travels to the driver. One row per id and date is expected; NULL values have no entry.
    """
    rows = rows.filter(F.col(value).isNotNull())
    n = rows.select(F.countDistinct("id")).scalar()
    blocks = F.ceil(F.greatest(n, F.lit(1)) / F.lit(ids or BLOCK_IDS))
    block = F.pmod(F.xxhash64(F.col("id").cast("string")), blocks)
    entry = F.struct(F.col("id").cast("string"), F.col(value).cast("double"))
    return rows.groupBy(block.alias("block"), by).agg(F.map_from_entries(F.collect_list(entry)).alias("values"))


def long_blocks(wide: DataFrame, value: str, by: str = "date") -> DataFrame:
    """(by, id, value) of a wide table in blocks."""
    return wide.select(by, F.explode("values").alias("id", value))


def read_windows(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Windows of a training run from its metadata JSON, or the default windows."""
    names = ("train_end", "forecast_start", "forecast_end", "model_dir")
    schema = ", ".join(f"{n} string" for n in names)
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            meta = spark.read.schema(f"windows array<struct<{schema.replace(' string', ':string')}>>")
            return meta.option("multiLine", True).json(path).select(F.inline("windows"))
    rows = [(e, a, b, f"window_{e.replace('-', '')}") for e, a, b in K.EXPANDING_WINDOWS]
    return spark.createDataFrame(rows, schema)


def save_run(root: str, forecasts=None, portfolio_returns=None, cumulative=None, performance=None) -> list[str]:
    """Tables of a run below ``root``: Parquet by model, performance as JSON. Returns the paths."""
    out = []
    for name, df in (("forecasts", forecasts), ("portfolio_returns", portfolio_returns), ("cumulative_returns", cumulative)):
        if df is not None:
            path = f"{root.rstrip('/')}/{name}"
            # a model's rows may come from many tasks; one model is not one file
            df.write.mode("overwrite").partitionBy("model").parquet(path)
            out.append(path)
    if performance is not None:
        path = f"{root.rstrip('/')}/performance"
        performance.coalesce(1).write.mode("overwrite").json(path)
        out.append(path)
    return out


def save_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """CSV with a header. ``single_file`` is for report tables, which have one row per month."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def dataset_key(source: str, ids: Sequence[str], start: str, end: str) -> str:
    """Name of a dataset: a digest of what was asked for, whatever the order of the ids."""
    asked = json.dumps({"from": start, "to": end, "of": source, "ids": sorted(map(str, ids))}, sort_keys=True)
    return hashlib.sha256(asked.encode()).hexdigest()[:20]


class DatasetStore:
    """Datasets written once per key and read back afterwards."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def load(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = self._path(key)
        if not self._exists(f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return bool(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


# Named readers: a custom source is a function (spark, **params) -> panel DataFrame
READERS: dict[str, Callable[..., DataFrame]] = {}


def register_reader(name: str, reader: Callable[..., DataFrame]) -> None:
    READERS[name.lower()] = reader


def read_source(spark: SparkSession, name: str, **params) -> DataFrame:
    try:
        reader = READERS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown source {name!r}; available: {', '.join(sorted(READERS))}") from None
    return reader(spark, **params)
