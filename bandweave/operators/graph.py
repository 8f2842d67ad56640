"""Graphs as edge tables: components, closure, exposure, blast radius, ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, stored


def shared_keys(items: DataFrame, item: str = "item_id", key: str = "key") -> DataFrame:
    """(a, b): each item with the smallest item of each of its keys, so a key of k items gives k edges, not k squared."""
    first = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(item).alias("b"))
    return items.join(first, key).select(F.col(item).alias("a"), "b").where("a <> b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b); nodes without edges are their own.

    Each round every node takes the smallest label of its neighbours and then
    that label's own label, so the rounds grow with the logarithm of the
    longest path; it ends when no label changes.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = stored(both.toDF("a", "b"), "graph-edges")
    labels = stored(nodes.select("node").distinct().withColumn("label", F.col("node")), "graph-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a, "left").select(
            "node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        new = stored(
            lower.join(jump, F.col("label") == F.col("via"), "left").select(
                "node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"
            ),
            "graph-labels",
        )
        forget(labels)
        if new.where("label < old").isEmpty():
            forget(both)
            return new.select("node", F.col("label").alias("component"))
        labels = new


def closure(nodes: DataFrame, depth: int = 100) -> DataFrame:
    """(ancestor, node, hops): each node below each start, itself included.

    nodes has node, parent and is_start. A level is a table of its own, made from
    the one above; it ends when no node has children left. A tree of more levels
    than depth, or one with a cycle, raises ValueError.
    """
    below = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("_at"), F.col("node").alias("_next"))
    level = stored(nodes.where("is_start").select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("hops")), "closure")
    found = level
    for hops in range(1, depth + 2):
        step = level.join(below, F.col("node") == F.col("_at"))
        level = stored(step.select("ancestor", F.col("_next").alias("node"), F.lit(hops).alias("hops")).distinct(), "closure")
        if level.isEmpty():
            forget(level)
            return found.groupBy("ancestor", "node").agg(F.min("hops").alias("hops"))
        found = found.union(level)
    raise ValueError(f"a tree of more than {depth} levels, or one with a cycle")


def exposure(origins: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(component, hop): what depends on the origins, directly or over up to hops steps; the shortest way counts.

    edges (source, target): source depends on target. Origins are left out.
    """
    seen = origins.select(F.col("component")).distinct()
    front, out = seen, None
    for hop in range(1, hops + 1):
        front = (
            edges.join(front, edges.target == front.component)
            .select(F.col("source").alias("component"))
            .distinct()
            .join(seen, "component", "left_anti")
        )
        found = front.withColumn("hop", F.lit(hop))
        out = found if out is None else out.unionByName(found)
        seen = seen.union(front)
    return out


def blast_radius(start, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, hop): everything that depends on start over any number of steps; start itself has hop 0."""
    spark = edges.sparkSession
    kind = nodes.schema["component"].dataType.simpleString()
    seen = spark.createDataFrame([(start, 0)], f"component {kind}, hop int")
    front, hop = seen, 0
    while True:
        hop += 1
        front = stored(
            edges.join(front.select(F.col("component").alias("_at")), edges.target == F.col("_at"))
            .select(F.col("source").alias("component"))
            .distinct()
            .join(seen, "component", "left_anti")
            .withColumn("hop", F.lit(hop)),
            "graph-front",
        )
        if front.isEmpty():
            forget(front)
            return seen
        seen = seen.unionByName(front)


def ancestors(pages: DataFrame, depth: int = 10) -> DataFrame:
    """(page, hops, title): titles up the chain of parents, nearest first, at most depth; a cycle ends it."""
    above = pages.select(F.col("page").alias("_page"), F.col("parent").alias("_parent"))
    path = F.array("page").alias("path")
    level = stored(pages.where("parent IS NOT NULL").select("page", F.col("parent").alias("at"), F.lit(1).alias("hops"), path), "ancestors")
    found = level
    for hops in range(2, depth + 1):
        step = level.join(above.where("_parent IS NOT NULL"), F.col("at") == F.col("_page")).where("NOT array_contains(path, _page)")
        path = F.array_append("path", F.col("_page")).alias("path")
        level = stored(step.select("page", F.col("_parent").alias("at"), F.lit(hops).alias("hops"), path), "ancestors")
        if level.isEmpty():
            forget(level)
            break
        found = found.union(level)
    titled = pages.select(F.col("page").alias("_page"), "title")
    return found.join(titled, F.col("at") == F.col("_page")).where("NOT array_contains(path, at)").select("page", "hops", "title")


def cycle_violations(tree: DataFrame) -> DataFrame:
    """Starts that have another start above them."""
    below = closure(tree).where("hops > 0")
    starts = tree.where("is_start").select("node")
    return below.join(starts, "node").select("ancestor", "node").distinct()


def earliest(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
