"""The vendor's monthly security file: text and Parquet scans, conversion, panel loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import calendar as C
from ..functions.scalars import compound_delisting, delisting_return, nan_to_null, tokens_to_null
from ..operators.panel import common_shares, integer_ids, keep_one

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "date": T.DateType(), "double": T.DoubleType(), "string": T.StringType()}


def schema_of(text: str) -> T.StructType:
    """'name kind, name kind' to a schema, without a session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in text.split(","))])


RAW_SCHEMA = schema_of(
    "PERMNO long, YYYYMM int, MthCalDt date, MthPrc double, MthRet double, MthCap double, PrimaryExch string, "
    "USIncFlg string, SecurityType string, ShareType string, SecuritySubType string, MthDelFlg string, DelReasonType string"
)
RETURN_COLUMNS = ("MthRet", "MthRetx", "DlRet")


def _typed(name: str, kind: T.DataType, tokens: Sequence[str]) -> Column:
    text = tokens_to_null(F.col(name), tokens)
    if isinstance(kind, T.StringType):
        return text.alias(name)
    if isinstance(kind, T.DateType):
        return C.lenient_date(text).alias(name)
    value = text.try_cast(kind)
    return (nan_to_null(value) if isinstance(kind, T.DoubleType) else value).alias(name)


def scan_text(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_SCHEMA,
    tokens: Sequence[str] = K.NULL_TOKENS,
    return_tokens: Sequence[str] = K.RETURN_NULL_TOKENS,
) -> DataFrame:
    """CSV with several missing-value tokens. Columns are matched by header name.

    The reader takes one null token, so columns come in as text and are cleaned and cast here;
    what does not parse becomes NULL.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    return raw.select(
        *[_typed(f.name, f.dataType, return_tokens if f.name in RETURN_COLUMNS else tokens) for f in schema.fields]
    )


def scan(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Panel file, Parquet or CSV by its name."""
    if path.rstrip("/").lower().endswith((".csv", ".txt", ".csv.gz")):
        return scan_text(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


def file_schema(spark: SparkSession, path: str) -> T.StructType:
    """Types of all columns of a text file; unknown columns are judged by all their values."""
    raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    known = {c: T.StringType() for c in K.VENDOR_TEXT_COLUMNS} | {c: T.DateType() for c in K.VENDOR_DATE_COLUMNS}
    known |= {f.name: f.dataType for f in RAW_SCHEMA.fields}
    unknown = [c for c in raw.columns if c not in known]
    if unknown:
        value = lambda c: tokens_to_null(F.col(f"`{c}`"), K.NULL_TOKENS)
        # The cast also reads codes such as 1D and 2F as numbers; they are text.
        number = lambda c: value(c).try_cast("double").isNotNull() & ~value(c).rlike("[dDfF]$")
        numeric = lambda c: F.coalesce(F.bool_and(number(c) | value(c).isNull()) & (F.count(value(c)) > 0), F.lit(False))
        found = raw.agg(*[numeric(c).alias(str(k)) for k, c in enumerate(unknown)]).head()
        known |= {c: T.DoubleType() if found[k] else T.StringType() for k, c in enumerate(unknown)}
    return T.StructType([T.StructField(c, known[c]) for c in raw.columns])


def convert(
    spark: SparkSession,
    csv_path: str,
    parquet_path: str,
    schema: T.StructType | None = None,
    compression: str = "zstd",
    row_group_bytes: int = 128 * 1024 * 1024,
) -> DataFrame:
    """Text file to typed Parquet with every column of the file.

    Known columns have their type, the vendor's codes and names stay text, its date columns parse
    leniently, and other columns become numbers where all their values are numbers, else they stay
    text. Judging them takes a pass of its own over the file.
    """
    schema = schema or file_schema(spark, csv_path)
    (
        scan_text(spark, csv_path, schema, return_tokens=K.NULL_TOKENS)
        .write.mode("overwrite")
        .option("compression", compression)
        .option("parquet.block.size", row_group_bytes)
        .parquet(parquet_path)
    )
    return spark.read.schema(schema).parquet(parquet_path)


def preview(df: DataFrame, n: int = 5, columns: Sequence[str] = K.VENDOR_KEY_COLUMNS) -> DataFrame:
    """First rows of the key columns that exist, as a check after conversion."""
    return df.select(*[c for c in columns if c in df.columns]).limit(n)


def schema_table(df: DataFrame, columns: Sequence[str] = K.VENDOR_KEY_COLUMNS) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name in columns]
    return df.sparkSession.createDataFrame(rows, "column string, type string")


def universe(name: str) -> tuple[str, ...]:
    """Exchanges of a named universe."""
    try:
        return K.UNIVERSES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown universe {name!r}; available: {', '.join(K.UNIVERSES)}") from None


def load_panel(
    raw: DataFrame,
    start: str,
    end: str,
    exchanges: Sequence[str] = K.UNIVERSES["crsp_all"],
    ids: DataFrame | Sequence | None = None,
    ordinary_only: bool = True,
    handle_delisting: bool = True,
) -> DataFrame:
    """Long panel (id, mi, date, price, ret, mcap, exch) of a period.

    Filters act on raw columns, so they reach the file scan. Negative prices are bid/ask
    averages. A list of ``ids`` without a whole number selects nothing. Several rows of one security and month are reduced to the last by date.
    """
    lo, hi = C.period_index(start), C.period_index(end)
    to_ym = lambda mi: mi // 12 * 100 + mi % 12 + 1
    rows = raw.filter(F.col("YYYYMM").between(to_ym(lo), to_ym(hi)))
    rows = common_shares(rows, exchanges) if ordinary_only else rows.filter(F.col("PrimaryExch").isin(*exchanges))
    if isinstance(ids, DataFrame):
        rows = rows.join(integer_ids(ids).withColumnRenamed("id", "PERMNO").distinct(), "PERMNO", "left_semi")
    elif ids is not None:
        wanted = [int(i) for i in ids if str(i).strip().lstrip("+-").isdigit()]
        rows = rows.filter(F.col("PERMNO").isin(wanted) if wanted else F.lit(False))
    ret = nan_to_null("MthRet")
    if "DlRet" in raw.columns:
        ret = compound_delisting(ret, nan_to_null("DlRet"))
    out = rows.select(
        F.col("PERMNO").alias("id"),
        C.month_index("MthCalDt").alias("mi"),
        F.col("MthCalDt").alias("date"),
        F.abs(nan_to_null("MthPrc")).alias("price"),
        (delisting_return(ret, F.col("DelReasonType")) if handle_delisting else ret).alias("ret"),
        nan_to_null("MthCap").alias("mcap"),
        F.col("PrimaryExch").alias("exch"),
    )
    return keep_one(out, ["id", "mi"], ["date", "mcap", "price", "ret", "exch"], keep="last")


def load_returns(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Returns alone: three columns, a period, no missing values."""
    lo, hi = C.period_index(start), C.period_index(end)
    first = f"{lo // 12:04d}-{lo % 12 + 1:02d}-01"
    return (
        raw.select("PERMNO", "MthCalDt", "MthRet")
        .filter((F.col("MthCalDt") >= F.lit(first).cast("date")) & (F.col("MthCalDt") <= F.last_day(C.month_start(F.lit(hi)))))
        .select(
            F.col("PERMNO").alias("id"), C.month_index("MthCalDt").alias("mi"),
            F.col("MthCalDt").alias("date"), nan_to_null("MthRet").alias("ret"),
        )
        .filter(F.col("ret").isNotNull())
    )
