"""Discovery over different signatures: the right members, and no items in a broadcast."""

from __future__ import annotations

from bandweave.operators import discovery

#: item, source, signature. The items of a leaf's source that hold its common tokens belong to it.
ITEMS = [
    (1, "a", ["x", "y"]), (2, "a", ["y", "x"]), (3, "a", ["x", "y", "z", "z"]), (4, "a", ["x", "y", "p", "q", "r"]),
    (5, "b", ["x", "y"]), (6, "b", ["q"]), (7, "b", []), (8, "a", None), (9, "b", ["q", "q"]),
]


def _broadcast(plan) -> list[str]:
    """Names of what the plan's broadcasts hold."""
    own = [plan.output().mkString(",")] if plan.nodeName().startswith("BroadcastExchange") else []
    below = plan.children()
    return own + [x for i in range(below.size()) for x in _broadcast(below.apply(i))]


def _items(spark, path):
    spark.createDataFrame(ITEMS, "item_id bigint, source string, signature array<string>").write.parquet(str(path / "items"))
    return spark.read.parquet(str(path / "items"))


def test_members_of_leaves(spark, tmp_path):
    found = discovery.memberships(_items(spark, tmp_path), 0.5).select("cluster", "source", "item_id")
    found = {tuple(r) for r in found.collect()}
    assert found == {(1, "a", 1), (1, "a", 2), (1, "a", 3), (1, "a", 4), (4, "a", 4), (5, "b", 5), (6, "b", 6), (6, "b", 9)}


def test_items_are_in_no_broadcast(spark, tmp_path):
    found = discovery.memberships(_items(spark, tmp_path), 0.5)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = found._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert not [x for x in _broadcast(plan) if "item_id" in x]
