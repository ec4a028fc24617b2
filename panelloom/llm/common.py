"""Small helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.operators.store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The whole text; null reads as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the byte-wise way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where the optimizer copies the expression into a filter."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held_out(doc_id: Column) -> Column:
    """Rows kept for evaluation; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` does not have, so that operators can carry columns of any name."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name, k = f"_{base}", 0
        while name.lower() in taken:
            k += 1
            name = f"_{base}{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_stored_position(df: DataFrame, name: str) -> DataFrame:
    """``df`` with each row's number (from 0, gapless) in the order in which it was written.

    Readers deal files out by size, so a task's rows do not show that order. It is the order of
    the part numbers in the file names, then of the rows in a file. A frame that is not a plain
    file scan is written first. The only broadcast has one row per file.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = written(df, "stored-order")
    file, row, first = fresh(df, "file", "row", "first")
    meta = df.metadataColumn("_metadata")
    located = df.select("*", meta["file_path"].alias(file), meta["row_index"].alias(row))
    part = F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).try_cast("long")
    before = Window.partitionBy(F.lit(0)).orderBy(part, file).rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = located.groupBy(file).agg(F.count(F.lit(1)).alias(first)).select(file, F.coalesce(F.sum(first).over(before), F.lit(0)).alias(first))
    return located.join(F.broadcast(files), file).select(*[F.col(f"`{c}`") for c in df.columns], (F.col(first) + F.col(row)).alias(name))


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = 16) -> DataFrame:
    """``left`` left join ``right`` on ``key``, where one key may hold much of ``left``.

    ``right`` has one row per key and is repeated once per salt, so the rows of a hot key meet
    their partner in ``salts`` tasks.
    """
    (salt,) = fresh(left, "salt")
    a = left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)))
    b = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return a.join(b, [key, salt], "left").drop(salt)
