"""The human-written text behind evidence: raw tables by source kind, evidence joined back to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Columns that hold identifiers, times or bookkeeping instead of prose.
NOT_PROSE_ENDINGS = ("_id", "_at", "_by", "id")
NOT_PROSE = {"id", "timestamp", "status", "environment", "state", "severity"}


def row_prose(table: DataFrame, id_column: str) -> Column:
    """All strings that aren't blank and all lists that aren't empty of a row, joined by spaces; identifiers are left out."""
    parts = []
    for field in table.schema.fields:
        name, value = field.name, F.col(f"`{field.name}`")
        if name == id_column or name in NOT_PROSE or name.endswith(NOT_PROSE_ENDINGS):
            continue
        if isinstance(field.dataType, StringType):
            parts.append(F.when(F.trim(value) != "", value))
        elif isinstance(field.dataType, ArrayType):
            parts.append(F.when(F.size(value) > 0, F.concat(F.lit("['"), F.array_join(value.cast("array<string>"), "', '"), F.lit("']"))))
    return F.concat_ws(" ", *parts) if parts else F.lit("")


def raw_texts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(kind, place, ref, text) of every raw row with an id and some prose; place: the order of the tables.

    tables maps a source kind to its table and the column that evidence refers to.
    """
    parts = [
        df.select(F.lit(kind).alias("kind"), F.lit(place).alias("place"), F.col(key).cast("string").alias("ref"), row_prose(df, key).alias("text"))
        for place, (kind, (df, key)) in enumerate(tables.items())
    ]
    return reduce(DataFrame.unionByName, parts).where("ref <> '' AND text <> ''")


def evidence_prose(evidence: DataFrame, raw: DataFrame, *keep: str) -> DataFrame:
    """Columns keep of evidence (source, ref) and the text of its own kind's row, else of the first table that has the ref.

    Raw rows are folded to one row a ref first, so evidence is joined once and
    never multiplied. Evidence without text is left out; of equal kinds and refs
    the first text by name counts.
    """
    one = raw.groupBy("ref", "kind", "place").agg(F.min("text").alias("text"))
    folded = one.groupBy("ref").agg(F.map_from_entries(F.collect_list(F.struct("kind", "text"))).alias("own"), F.min_by("text", "place").alias("any"))
    found = evidence.join(folded, "ref")
    return found.select(*keep, F.coalesce(F.try_element_at("own", F.col("source")), "any").alias("text"))
