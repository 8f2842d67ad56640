"""What the absence of some employees does to the best score of each capability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures


def simulate(scores: DataFrame, absent: list) -> DataFrame:
    """Capability: best score before, after and among the absent, bands, number remaining, and whether a gap is left.

    scores has employee_id, capability_id, score. One aggregation; the absent are
    a parameter, not a table.
    """
    away = F.col("employee_id").isin(*absent) if absent else F.lit(False)
    best = lambda c: F.coalesce(F.max(F.when(c, F.col("score"))), F.lit(0.0))
    out = scores.groupBy("capability_id").agg(
        F.coalesce(F.max("score"), F.lit(0.0)).alias("before"),
        best(~away).alias("after"),
        best(away).alias("absent_best"),
        F.count_if(~away & (F.col("score") > 0)).alias("remaining"),
    )
    band = measures.score_band(F.col("after"))
    return out.withColumns(
        {
            "before_band": measures.score_band(F.col("before")),
            "after_band": band,
            "status": measures.status(F.col("before"), F.col("after")),
            "gap": band.isin("LOW", "NONE"),
        }
    )


def gaps(simulated: DataFrame) -> DataFrame:
    """Capabilities left with a low or no band; none first, then by score."""
    return simulated.where("gap").orderBy(F.col("after_band") != "NONE", "after", "capability_id")


def evidence_sources(evidence: DataFrame) -> DataFrame:
    """Capability: number of pieces of evidence by source, as a map."""
    counted = evidence.groupBy("capability_id", "source").count()
    pair = F.struct("source", "count")
    return counted.groupBy("capability_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("evidence_by_source")
    )
