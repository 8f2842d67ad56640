"""A key of many leaves on both sides isn't multiplied out."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandweave.operators import discovery


def joined_rows(df) -> int:
    """The most rows that a join of an executed plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    found, todo = [0], [plan]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        kids = list(map(node.children().apply, range(node.children().size())))
        if node.nodeName().endswith("QueryStage"):
            kids.append(node.plan())
        if "AQEShuffleRead" in node.nodeName():
            kids.append(node.child())
        todo.extend(kids)
    return max(found)


def test_a_key_of_many_leaves_gives_a_row_a_leaf(spark):
    code = spark.range(300).select(F.col("id").alias("leaf"), F.lit("github").alias("source"), F.lit("PAY-1").alias("key"))
    other = spark.range(1000, 1300).select(F.col("id").alias("leaf"), F.lit("jira").alias("source"), F.lit("PAY-1").alias("key"))
    found = discovery.merge_sources(code.unionByName(other))
    assert joined_rows(found) <= 300
    assert sorted((r.leaf, r.parent) for r in found.collect()) == [(0, 0), *((k, 0) for k in range(1000, 1300))]
