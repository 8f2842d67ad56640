"""Registration of plans: a query over the test tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def plan(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def register(f):
        if name in PLANS:
            raise ValueError(f"two plans are called {name}")
        PLANS[name] = (f, sql)
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
