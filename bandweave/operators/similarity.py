"""Clusters of items by the similarity of their signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures
from ..storage import stored
from . import graph

#: Tasks over which the signatures of one token are dealt, where they meet all others of the token.
SALTS = 8


def similar_signatures(items: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs of distinct signatures of one source whose Jaccard similarity reaches the threshold.

    items has source and signature (an array of distinct tokens). Signatures are
    collapsed first. Only the rarest tokens of each are matched (a pair that
    reaches the threshold shares one of the first size - ceil(threshold * size)
    + 1), and each candidate is verified on its whole sets, where it meets: at the
    first token that both match by, so that no pair is kept to be told from
    another. A token's signatures are dealt over SALTS tasks.
    """
    sigs = (
        items.select("source", F.array_sort(F.array_distinct("signature")).alias("sig"))
        .where(F.size("sig") > 0)
        .distinct()
        .withColumn("sig_id", F.sha2(F.concat_ws("\x1f", "source", F.array_join("sig", "\x1f")), 256))
    )
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that few rows that become many pairs aren't put together
    rare = sigs.select("source", F.explode("sig").alias("token")).groupBy("source", "token").count()
    ranked = sigs.select("source", "sig_id", "sig", F.explode("sig").alias("token")).join(rare, ["source", "token"])
    ordered = ranked.groupBy("source", "sig_id", "sig").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("_order"))
    n = F.size("sig")
    first = F.transform(F.slice("_order", F.lit(1), (n - F.ceil(F.lit(threshold) * n) + 1).cast("int")), lambda o: o["token"])
    prefix = ordered.withColumn("keys", first).select("source", "sig_id", "sig", "keys", F.explode("keys").alias("token"))
    left = prefix.select("source", "token", F.col("sig_id").alias("a_id"), F.col("sig").alias("a"), F.col("keys").alias("a_keys"))
    left = left.withColumn("salt", F.pmod(F.xxhash64("a_id"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    right = prefix.select("source", "token", F.col("sig_id").alias("b_id"), F.col("sig").alias("b"), F.col("keys").alias("b_keys"), salts)
    at = ["source", "token", "salt"]
    met = left.repartition(tasks, *at).join(right.repartition(tasks, *at).hint("shuffle_hash"), at)
    small, large = F.least(F.size("a"), F.size("b")), F.greatest(F.size("a"), F.size("b"))
    once = F.array_intersect("a_keys", "b_keys")[0] == F.col("token")
    pairs = met.where((F.col("a_id") < F.col("b_id")) & (small >= F.lit(threshold) * large) & once)
    return (
        pairs.select("a_id", "b_id", "a", "b", measures.jaccard(F.col("a"), F.col("b")).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def signed(items: DataFrame) -> DataFrame:
    """Items of a signature that isn't empty, with sig_id, which stands for the source and the distinct tokens."""
    tokens = F.array_join(F.array_sort(F.array_distinct("signature")), "\x1f")
    return items.where(F.size("signature") > 0).withColumn("sig_id", F.sha2(F.concat_ws("\x1f", "source", tokens), 256))


def signature_clusters(items: DataFrame, threshold: float) -> DataFrame:
    """(sig_id, cluster): components of similar signatures, named by the smallest item."""
    first = signed(items).groupBy("sig_id").agg(F.min("item_id").alias("rep"))
    near = similar_signatures(items, threshold)
    edges = (
        near.select("a_id", "b_id")
        .join(first.select(F.col("sig_id").alias("a_id"), F.col("rep").alias("a")), "a_id")
        .join(first.select(F.col("sig_id").alias("b_id"), F.col("rep").alias("b")), "b_id")
        .select("a", "b")
    )
    found = graph.components(first.select(F.col("rep").alias("node")), edges)
    return first.join(found, first.rep == found.node).select("sig_id", F.col("component").alias("cluster"))


def clusters(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, cluster): components of items of similar signatures, named by the smallest item."""
    named = signature_clusters(items, threshold).hint("shuffle_hash")  # items never go through the driver
    return signed(items).select("item_id", "sig_id").join(named, "sig_id").select("item_id", "cluster")


def common_signature(members: DataFrame) -> DataFrame:
    """(cluster, common): tokens that all members of a cluster have, sorted."""
    sizes = members.groupBy("cluster").agg(F.countDistinct("item_id").alias("size"))
    tokens = members.select("cluster", "item_id", F.explode(F.array_distinct("signature")).alias("token"))
    shared = tokens.groupBy("cluster", "token").agg(F.countDistinct("item_id").alias("n")).join(sizes, "cluster")
    return shared.where("n = size").groupBy("cluster").agg(F.array_sort(F.collect_list("token")).alias("common"))


def work_units(items: DataFrame) -> DataFrame:
    """(unit, occurred_at, members): components over shared keys that aren't service keys; items has item_id, key, occurred_at."""
    keyed = items.where(F.col("key").isNull() | ~F.col("key").startswith("SVC:"))
    nodes = items.select(F.col("item_id").alias("node"))
    found = graph.components(nodes, graph.shared_keys(keyed))
    dated = items.groupBy("item_id").agg(F.max("occurred_at").alias("occurred_at"))
    joined = dated.join(found, dated.item_id == found.node)
    return joined.groupBy(F.col("component").alias("unit")).agg(
        F.max("occurred_at").alias("occurred_at"), F.count("*").alias("members")
    )


def nearest_ranks(rows: DataFrame, keys: tuple[str, ...], value: str, **quantiles: float) -> DataFrame:
    """Of each group, for each name the value of rank round(q * (n - 1)), half to even, among all sorted values.

    Equal values are counted before anything is sorted, so a group's size doesn't
    matter, only the number of its distinct values. Null values don't count; a
    table without any gives 1.0 where there are no keys.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    placed = _placed_by_group(counted, keys, value) if keys else _placed_by_range(counted, value)
    at = lambda q: F.min(F.when(F.col("_until") > F.bround(F.lit(q) * (F.col("_n") - 1), 0), F.col(value))).cast("double")
    return placed.groupBy(*keys).agg(*(F.coalesce(at(q), F.lit(1.0)).alias(name) for name, q in quantiles.items()))


def _placed_by_group(counted: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """counted with _until, how many rows there are up to a value, and _n, how many in its group."""
    group = Window.partitionBy(*keys)
    return counted.withColumns({"_until": F.sum("_k").over(group.orderBy(value)), "_n": F.sum("_k").over(group)})


def _placed_by_range(counted: DataFrame, value: str) -> DataFrame:
    """The same without groups: values are dealt out by range, and a part goes on from the sums of those before it."""
    parts = stored(counted.repartitionByRange(value).withColumn("_part", F.spark_partition_id()), "ranks")
    sums, before = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.sum("_k").alias("n")).collect()}, {}  # a row a part
    for part in sorted(sums):
        before[part] = sum(n for p, n in sums.items() if p < part)
    starts = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    inside = F.sum("_k").over(Window.partitionBy("_part").orderBy(value))
    return parts.withColumns({"_until": inside + starts[F.col("_part")], "_n": F.lit(sum(sums.values()))})


def best_match(items: DataFrame, summaries: DataFrame, floor: float = 0.25) -> DataFrame:
    """Each item's most similar summary by cosine of vectors, at least floor; ties to the smaller summary.

    items has item_id and vector; summaries node_id and vector. Every item meets
    every summary, which is the result's rule; Spark sends the summaries to all
    tasks only where they are small enough.
    """
    pairs = items.crossJoin(summaries.select("node_id", F.col("vector").alias("other")))
    scored = pairs.withColumn("similarity", measures.cosine(F.col("vector"), F.col("other")))
    best = F.max_by(F.struct("node_id", "similarity"), F.struct("similarity", (-F.col("node_id")).alias("tie")))
    return scored.groupBy("item_id").agg(best.alias("best")).select("item_id", "best.*").where(F.col("similarity") >= floor)
