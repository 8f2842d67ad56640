"""Sinks: append what is new, keep the last, overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import datasets


def only_new(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct incoming rows whose keys aren't stored."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored with rows of equal keys replaced by incoming; of incoming rows of equal keys any one."""
    kept = stored.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming.dropDuplicates(keys))


def merge_manual(stored: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Derived rows replace stored ones, but for those set by hand."""
    both = stored.withColumn("_old", F.lit(1)).unionByName(derived.withColumn("_old", F.lit(0)))
    manual = (F.col("status") == "manual") & (F.col("_old") == 1)
    w = Window.partitionBy(key).orderBy(F.when(manual, 0).when(F.col("_old") == 0, 1).otherwise(2))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_old")


def report(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """One row: fetched, inserted and duplicate rows."""
    new = only_new(incoming, stored, keys).agg(F.count("*").alias("inserted"))
    return incoming.agg(F.count("*").alias("fetched")).crossJoin(new).withColumn("duplicate", F.expr("fetched - inserted"))


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def set_value(config: DataFrame, key: str, **columns) -> DataFrame:
    """config (key and further columns) with one key's row replaced or added; columns not given are null."""
    spark, names = config.sparkSession, config.columns
    row = spark.createDataFrame([tuple({"key": key, **columns}.get(n) for n in names)], config.schema)
    return config.where(F.col("key") != key).unionByName(row)


def value(config: DataFrame, key: str):
    """The value of a key; KeyError without one."""
    row = config.where(F.col("key") == key).select("value").first()
    if row is None:
        raise KeyError(key)
    return row.value


def add_edge(edges: DataFrame, nodes: DataFrame, source, target) -> DataFrame:
    """edges (source, target) with one more, once; ValueError if it would point at itself, KeyError at an unknown end."""
    if source == target:
        raise ValueError(f"{source} cannot depend on itself")
    known = {r[0] for r in nodes.where(F.col(nodes.columns[0]).isin(source, target)).select(nodes.columns[0]).distinct().collect()}  # two at most
    for end in (source, target):
        if end not in known:
            raise KeyError(end)
    new = edges.sparkSession.createDataFrame([(source, target)], edges.select("source", "target").schema)
    return edges.select("source", "target").unionByName(new).distinct()


def remove_edge(edges: DataFrame, source, target) -> DataFrame:
    """edges without one; KeyError if there is none."""
    gone = (F.col("source") == source) & (F.col("target") == target)
    if edges.where(gone).isEmpty():
        raise KeyError(f"{source}->{target}")
    return edges.where(~gone)


def write_all(made: DataFrame, given: DataFrame, path: str) -> None:
    """Put made as JSON in place of the dataset at path; ValueError, and the old one stays, unless it has as many rows as given."""
    datasets.replace(made, path, "json", expected=given.count())


def write_outputs(outputs: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Each table as a JSON dataset of its name below folder, replaced whole; the rows of each."""
    return {name: datasets.replace(df, f"{folder}/{name}", "json") for name, df in outputs.items()}
