"""Drill-downs: the evidence of one capability, and single records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates

#: Kinds of tokens by which an excluded item belongs to a capability, and how many are shown.
SCOPES, SHOWN = ("dir:", "component:", "label:", "service:"), 25


def evidence(edges: DataFrame, bands: DataFrame, capability, as_of, removed=None) -> DataFrame:
    """(person, band_code, removed, unit_count, items) of everyone with evidence of a capability.

    edges is what ceilings() gives; items are structs of occurred_at, item_id, unit,
    role, certainty, ceiling, binding_cap and age, the latest first, equal times by
    item_id. removed marks the person who is taken away.
    """
    mine = edges.where(F.col("capability") == F.lit(capability))
    names = F.when(dates.age_cap(F.col("unit_at"), as_of) == 3, "fresh").when(dates.age_cap(F.col("unit_at"), as_of) == 2, "aging").otherwise("stale")
    item = F.struct(
        (-F.unix_date(F.col("occurred_at").cast("date"))).alias("order"), "item_id", "occurred_at", "unit", "role", "certainty", "ceiling", "binding_cap", names.alias("age")
    )
    by = mine.groupBy("person").agg(F.countDistinct("unit").alias("unit_count"), F.array_sort(F.collect_list(item)).alias("items"))
    held = bands.where(F.col("capability") == F.lit(capability)).select("person", "band_code")
    out = by.join(held, "person", "left").withColumn("removed", F.coalesce(F.col("person") == F.lit(removed), F.lit(False)))
    return out.select("person", F.coalesce("band_code", F.lit(0)).alias("band_code"), "removed", "unit_count", "items")


def excluded(items: DataFrame, own: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first excluded items that share a token of SCOPES with a capability's own items, by item_id.

    items has item_id, eligible, exclusion_reason, tokens; own has the item_id of the capability's members.
    """
    scoped = F.explode(F.filter("tokens", lambda t: t.rlike(f"^(?:{'|'.join(SCOPES)})"))).alias("token")
    signature = items.where("eligible").join(own.select("item_id").distinct(), "item_id", "left_semi").select(scoped).distinct()
    hit = items.where("NOT eligible").select("item_id", "exclusion_reason", scoped).join(signature, "token", "left_semi")
    return hit.select("item_id", "exclusion_reason").distinct().orderBy("item_id").limit(shown)


def record(records: DataFrame, record_id) -> DataFrame:
    """The one row of a record; KeyError if there is none."""
    found = records.where(F.col("record_id") == F.lit(record_id))
    if found.isEmpty():
        raise KeyError(record_id)
    return found
