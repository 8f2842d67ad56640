"""Closures and ancestors of more rows than a recursive query of Spark takes, and their hard cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bandweave.operators import graph

ROWS = 1_000_100


def _wide(spark):
    """One start above ROWS nodes."""
    leaves = spark.range(1, ROWS + 1, 1, 8).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("parent"), F.lit(False).alias("is_start"))
    return leaves.union(spark.sql("SELECT 0L, CAST(NULL AS LONG), true"))


def test_closure_of_over_a_million_rows(spark):
    found = graph.closure(_wide(spark), depth=5)
    assert {(r.hops, r["count"]) for r in found.groupBy("hops").count().collect()} == {(0, 1), (1, ROWS)}


def test_ancestors_of_over_a_million_pages(spark):
    pages = _wide(spark).select(F.col("node").alias("page"), "parent", F.concat(F.lit("T"), "node").alias("title"))
    found = graph.ancestors(pages).groupBy("hops", "title").count().collect()
    assert [tuple(r) for r in found] == [(1, "T0", ROWS)]


def test_closure_takes_the_shortest_way_and_raises_on_cycles(spark):
    rows = [("a", None, True), ("b", "a", False), ("c", "b", False), ("c", "a", False), ("d", "c", True)]
    found = graph.closure(spark.createDataFrame(rows, "node string, parent string, is_start boolean"), depth=3)
    assert {tuple(r) for r in found.collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("d", "d", 0)}
    loop = spark.createDataFrame([("a", "b", True), ("b", "a", False)], "node string, parent string, is_start boolean")
    with pytest.raises(ValueError):
        graph.closure(loop, depth=4)
    assert graph.closure(loop.where("false")).count() == 0


def test_ancestors_end_at_a_cycle_and_at_the_depth(spark):
    rows = [("a", "b", "A"), ("b", "a", "B"), ("c", "a", "C"), ("x", "gone", "X")]
    pages = spark.createDataFrame(rows, "page string, parent string, title string")
    assert {tuple(r) for r in graph.ancestors(pages).collect()} == {("a", 1, "B"), ("b", 1, "A"), ("c", 1, "A"), ("c", 2, "B")}
    assert {tuple(r) for r in graph.ancestors(pages, 1).collect()} == {("a", 1, "B"), ("b", 1, "A"), ("c", 1, "A")}
