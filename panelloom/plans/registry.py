"""Registry of named queries with their SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import rounded, with_parts
from .tables import Tables, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ITEMS: dict[str, str] = {}


def query(name: str, items: str, sql: str | None = None, parts: str = "", r: str = "", digits: int = 8):
    """Register ``f(tables)`` under ``name``.

    ``items``: inventory rows it shows. ``r``: floating-point columns, rounded on both sides
    because sums are added in different orders. Without ``sql`` there is no SQL check.
    """

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            out = f(tables(spark, sf))
            cols = set(r.split())
            return out.select(*[F.round(c, digits).alias(c) if c in cols else F.col(f"`{c}`") for c in out.columns])

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        ITEMS[name] = items
        if sql is not None:
            ORACLE[name] = with_parts(parts, rounded(sql, r, digits))
        return f

    return register
