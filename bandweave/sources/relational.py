"""Taxonomy and evidence of the relational schema in which a capability belongs to one component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def taxonomy(systems: DataFrame, components: DataFrame, capabilities: DataFrame) -> dict[str, DataFrame]:
    """capabilities, modules and services as read_taxonomy() gives them; ids become text, a component lists its capabilities.

    systems has system_id, name, description; components component_id, system_id,
    name, description; capabilities capability_id, component_id, name, description.
    """
    named = lambda df, key: df.select(F.col(key).cast("string").alias("id"), F.coalesce("name", F.col(key).cast("string")).alias("name"), F.coalesce("description", F.lit("")).alias("description"))
    held = capabilities.where("component_id IS NOT NULL").groupBy(F.col("component_id").cast("string").alias("id")).agg(
        F.array_sort(F.collect_set(F.col("capability_id").cast("string"))).alias("capability_ids")
    )
    services = components.select(F.col("component_id").cast("string").alias("id"), F.col("system_id").cast("string").alias("service_id"))
    modules = named(components, "component_id").join(services, "id").join(held, "id", "left")
    empty = F.array().cast("array<string>")
    return {
        "capabilities": named(capabilities, "capability_id"), "services": named(systems, "system_id"),
        "modules": modules.withColumn("capability_ids", F.coalesce("capability_ids", empty)),
    }


def evidence(rows: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(evidence_id, employee_id, capability_id, module_id, type, source, date, score, description) of rows of that schema.

    The module is the component of the capability that a row names; a strength
    that is missing or zero counts as 1; types are in lower case and dates are text.
    """
    owner = capabilities.select("capability_id", F.col("component_id").cast("string").alias("module_id"))
    text = lambda c: F.col(c).cast("string").alias(c)
    strength = F.when(F.coalesce("strength", F.lit(0.0)) != 0, F.col("strength").cast("double")).otherwise(F.lit(1.0))
    return rows.join(owner, "capability_id", "left").select(
        text("evidence_id"), text("employee_id"), text("capability_id"), "module_id", F.lower("evidence_type").alias("type"), F.lit("database").alias("source"),
        F.col("observed_at").cast("date").cast("string").alias("date"), strength.alias("score"), F.coalesce("description", F.lit("")).alias("description"),
    )
