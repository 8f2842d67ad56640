"""Which service a documentation space belongs to: kept as one JSON file, decided by hand or derived."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import datasets

ENTRY = "space_name string, service_id string, status string, score double, reasons array<string>, candidates array<string>"
SCHEMA = f"space_key string, {ENTRY}"


def parse(files: DataFrame) -> DataFrame:
    """Entries of mapping files (value: the whole file); what isn't JSON, or has no spaces, has none."""
    read = F.from_json("value", f"spaces map<string, struct<{', '.join(c.replace(' ', ': ', 1) for c in ENTRY.split(', '))}>>")
    return files.select(F.explode(read["spaces"]).alias("space_key", "e")).select("space_key", "e.*")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The mapping of a file, or the one that save() has put there; empty if there is none or it can't be read."""
    kept = datasets.read(spark, path, "parquet")
    if kept is not None:
        return kept.select(*(c.split(" ")[0] for c in SCHEMA.split(", ")))
    try:
        return parse(spark.read.text(path, wholetext=True))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def save(mapping: DataFrame, path: str) -> int:
    """Put the mapping, a row a space, in place of the one before; readers see either."""
    return datasets.replace(mapping.withColumn("generated_at", F.current_timestamp()), path)


def set_manual(mapping: DataFrame, space_key: str, service_id: str | None) -> DataFrame:
    """The mapping with a person's decision on one space, known or not; no service is a decision too."""
    known = mapping.where(F.col("space_key") == space_key)
    one = mapping.sparkSession.createDataFrame([(space_key, service_id)], "space_key string, service_id string")
    entry = one.join(known.select("space_key", "space_name", "score", "candidates"), "space_key", "left").select(
        "space_key", F.coalesce("space_name", F.lit("")).alias("space_name"), "service_id", F.lit("manual").alias("status"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.array(F.lit("set manually")).alias("reasons"),
        F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"),
    )
    return mapping.where(F.col("space_key") != space_key).unionByName(entry)
