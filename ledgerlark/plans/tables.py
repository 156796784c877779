"""Where queries get their tables, and how they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.sources.driver_tables import domain, oracle

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Domain and driver tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("trades", "daily_prices", "benchmark_prices", "earnings", "enforcement", "scored", "labelled"):
            return domain(self.spark, self.sf_dir, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Book:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Register the decorated function of :class:`Tables` under its name."""

        def put(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.oracles[f.__name__] = oracle(sql)
            return f

        return put


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Rounded columns, without negative zeros."""
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in places.items()})


def sql_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"
