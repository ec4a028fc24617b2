"""The return panel and what follows from it, derived from the given tables.

A supplier plays a security: its month's mean unit price is the price, its month's sales the
market value, its region the exchange. Tables that several queries use are written once per
session and data folder.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions.scalars import exact_sum
from ..operators import features as FT
from ..operators import panel as P
from ..operators import sorts as S
from ..operators.store import new_path, written, written_by_key
from ..sources import securities as SE


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """Security, nation and region."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n_nationkey"))
    n = read(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return s.join(n, "n_nationkey", "left").select("id", F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))


def build_panel(spark: SparkSession, sf: str) -> DataFrame:
    monthly = (
        read(spark, sf, "lineitem")
        .select(
            F.col("l_suppkey").alias("id"),
            F.last_day("l_shipdate").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
            "l_extendedprice",
        )
        .groupBy("id", "date")
        # Sums that do not depend on the order: equal securities stay equal, on a breakpoint too.
        .agg(F.try_divide(exact_sum("unit"), F.count("unit")).alias("price"), exact_sum("l_extendedprice").alias("mcap"))
        .withColumn("mi", C.month_index("date"))
    )
    exch = F.when(F.col("region") <= 2, "N").when(F.col("region") == 3, "A").otherwise("Q")
    prices = monthly.join(listed(spark, sf), "id", "left").select("id", "mi", "date", "price", "mcap", exch.alias("exch"))
    return prices


class Tables:
    """Derived tables of one data folder in one session."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self._made: dict[str, object] = {}

    def once(self, name: str, build):
        if name not in self._made:
            self._made[name] = build()
        return self._made[name]

    def path(self, name: str) -> str:
        return self.once(f"path:{name}", lambda: new_path(self.spark, name))

    @property
    def panel(self) -> DataFrame:
        """Prices, market values and returns; bucketed by security, so windows by id need no shuffle."""
        return self.once(
            "panel", lambda: written_by_key(P.simple_returns(build_panel(self.spark, self.sf)), "panel", "id", "mi")
        )

    @property
    def prices(self) -> DataFrame:
        return self.panel.drop("ret")

    @property
    def risk_free(self) -> DataFrame:
        rate = 0.002 + C.month_of("mi") * 0.0001
        return self.once(
            "rf",
            lambda: written(self.panel.select("mi", "date").distinct().select("mi", "date", C.ym_of_index("mi").alias("ym"), rate.alias("rate")), "rf"),
        )

    @property
    def features(self) -> DataFrame:
        return self.once("features", lambda: written_by_key(FT.lagged_features(self.panel), "features", "id", "mi"))

    @property
    def samples(self) -> DataFrame:
        return self.once("samples", lambda: written(FT.feature_samples(self.panel, "ret_rank_norm"), "samples"))

    @property
    def candidates(self) -> DataFrame:
        """One window per security over the bucketed panel: cheap enough to derive where needed."""
        return P.candidates(self.panel)

    @property
    def scores(self) -> DataFrame:
        """Two forecasts: momentum (cr12) and short-term reversal (-cr1)."""
        models = F.inline(
            F.array(
                F.struct(F.lit("momentum").alias("model"), F.col("cr12").alias("score")),
                F.struct(F.lit("reversal").alias("model"), (-F.col("cr1")).alias("score")),
            )
        )
        return self.features.select("mi", "id", models).select("model", "mi", "id", "score")

    @property
    def sort(self) -> S.QuantileSort:
        def build():
            s = S.quantile_sort(self.candidates, self.scores, 10, exchange_breakpoints="N")
            return S.QuantileSort(s.months, written(s.assigned, "assigned"), s.n)

        return self.once("sort", build)

    @property
    def series(self) -> DataFrame:
        return self.once("series", lambda: written(S.portfolio_returns(self.sort), "series"))

    @property
    def raw(self) -> DataFrame:
        """The panel in the vendor's columns, as text, with its missing-value tokens."""
        return self.once("raw", lambda: written(raw_security_file(self), "raw"))

    @property
    def raw_csv(self) -> str:
        def build():
            path = new_path(self.spark, "raw") + ".csv"
            self.raw.write.option("header", True).csv(path)
            return path

        return self.once("raw_csv", build)

    @property
    def scanned(self) -> DataFrame:
        return self.once("scanned", lambda: written(SE.scan_text(self.spark, self.raw_csv), "scanned"))

    @property
    def loaded(self) -> DataFrame:
        return self.once("loaded", lambda: written(SE.load_panel(self.scanned, "1995-01", "2001-12"), "loaded"))

    @property
    def daily_folder(self) -> str:
        """Constituent files below one folder per year, one per trading day (a Friday)."""

        def build():
            path = new_path(self.spark, "days")
            d = daily_rows(self, weekly=True)
            (
                d.withColumn("year", F.year("date"))
                .withColumn("day", F.concat(F.date_format("date", "yyyyMMdd"), F.lit(".csv")))
                .repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "day")
                .write.partitionBy("year", "day")
                .option("header", True)
                .csv(path)
            )
            return path

        return self.once("daily", build)


def daily_rows(t: Tables, weekly: bool = False) -> DataFrame:
    """Last unit price of each security and trading day, with the vendor's code.

    ``weekly``: every day of a week counts as its Friday, so a folder has one file per week.
    """
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    day = F.date_add(F.trunc("l_shipdate", "WEEK"), 4) if weekly else F.col("l_shipdate").cast("date")
    return (
        read(t.spark, t.sf, "lineitem")
        .groupBy(day.alias("date"), F.col("l_suppkey").alias("id"))
        .agg(F.max_by(unit, order).alias("CLOSE"))
        .select("date", F.concat(F.lit("S"), F.col("id"), F.lit(".O")).alias("wind_code"), "CLOSE")
    )


def raw_security_file(t: Tables) -> DataFrame:
    p = t.panel.join(listed(t.spark, t.sf).select("id", "region"), "id", "left")
    i, m = F.col("id"), F.col("mi")
    lost = (i * 13 + m) % 17 == 0
    token = F.element_at(F.array(F.lit(""), F.lit("."), F.lit("NA"), F.lit("C")), (m % 4 + 1).cast("int"))
    exch = (
        F.when(F.col("region") <= 1, "N").when(F.col("region") == 2, "A").when(F.col("region") == 3, "Q")
        .otherwise(F.when(i % 2 == 0, "P").otherwise("Z"))
    )
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % n + 1).cast("int"))
    rows = p.select(
        i.alias("PERMNO"),
        C.ym_of_index(m).alias("YYYYMM"),
        F.date_format("date", "yyyy-MM-dd").alias("MthCalDt"),
        F.when((i + m) % 7 == 0, -F.col("price")).otherwise(F.col("price")).cast("string").alias("MthPrc"),
        F.when(lost, token).otherwise(F.coalesce(F.col("ret").cast("string"), F.lit("."))).alias("MthRet"),
        F.when((i + m) % 29 == 0, 0.0).otherwise(F.col("mcap") / 1000).cast("string").alias("MthCap"),
        exch.alias("PrimaryExch"),
        F.when(i % 10 == 9, "N").otherwise("Y").alias("USIncFlg"),
        F.when(i % 13 == 12, "FUND").otherwise("EQTY").alias("SecurityType"),
        pick(4, "NS", "AD", "SB", "NS").alias("ShareType"),
        pick(3, "COM", "ETF", "COMAD").alias("SecuritySubType"),
        F.when(lost, "Y").otherwise("N").alias("MthDelFlg"),
        F.when(lost & (m % 3 == 0), "552").when(lost & (m % 3 == 1), "231").alias("DelReasonType"),
    )
    twice = rows.filter((F.col("PERMNO") + C.index_of_ym("YYYYMM")) % 31 == 0)
    return rows.unionByName(twice.withColumn("MthCap", (F.col("MthCap").cast("double") / 2).cast("string")))


@lru_cache(maxsize=16)
def _tables(app: str, sf: str, spark: SparkSession) -> Tables:
    return Tables(spark, sf)


def tables(spark: SparkSession, sf: str) -> Tables:
    return _tables(spark.sparkContext.applicationId, sf.rstrip("/"), spark)


def forget() -> None:
    _tables.cache_clear()
