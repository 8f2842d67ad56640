"""All queries of the reference's own operators, bound to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import discovering, extracting, ordinal, paging, reading, recording, reports, retrieving, scores, sourcing, storing, teaming, texts  # noqa: F401  they register their plans
from .registry import PLANS


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employee by capability: score, band and dates of evidence."""
    return scores.qry01(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
