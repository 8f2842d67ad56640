"""Bands are assigned in one pass over the edges, without sorting them where no unit is asked for."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from bandweave.operators import bands

NEW, OLD = date(2001, 10, 1), date(1998, 1, 1)
#: item, person, capability, unit, role, time of the unit, ceiling
EDGES = [
    (1, "p", "c", 10, "author", NEW, 1), (2, "p", "c", 11, "author", NEW, 2), (3, "p", "c", 12, "reviewer_approval", NEW, 2),
    (4, "q", "c", 10, "author", NEW, 1), (5, "q", "d", 13, "author", OLD, 2), (6, "q", "d", 14, "author", OLD, 2),
    (7, "r", None, 15, "author", NEW, 1), (8, "r", None, 16, "author", NEW, 1),
]


def _assigned(spark):
    kinds = "item_id bigint, person string, capability string, unit bigint, role string, unit_at date, ceiling int"
    return bands.assign(spark.createDataFrame(EDGES, kinds), F.lit("2001-11-05").cast("date"))


def test_bands_units_and_dominance(spark):
    found = {tuple(r) for r in _assigned(spark).select("person", "capability", "band_code", "unit", "dominant").collect()}
    assert found == {("p", "c", 3, 11, True), ("q", "c", 1, 10, False), ("q", "d", 2, 13, False), ("r", None, 1, 15, False)}


def test_bands_alone_need_one_pass_and_no_sort_of_the_edges(spark):
    plan = _assigned(spark).groupBy("capability", "band_code").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 1 and "SortAggregate" not in plan
