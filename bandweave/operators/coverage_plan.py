"""The coverage plan of a departure: who takes what, what nobody can take, and how sure that is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COVERAGE_THRESHOLD
from . import bands as ordinal
from . import teams


def coverage_plan(bands: DataFrame, components: DataFrame, leaving, threshold: int = COVERAGE_THRESHOLD) -> DataFrame:
    """(section, subject, detail, value), the sections of one plan in one table.

    target: each capability that the person covers. member: each person of the
    best team, with rationale and number of components touched. residual: each
    target that nobody else reaches, with the closest candidate in words. greedy:
    the picks of the greedy baseline in order, with what each adds. objective: the
    four values of the best assignment and of the runner-up; unique: 1 if the
    runner-up is worse. A person who covers nothing has no rows.
    """
    targets = ordinal.departure_targets(bands, leaving, threshold)
    others = bands.where(F.col("person") != F.lit(leaving))
    wanted = others.join(targets, "capability", "left_semi")
    qualified = wanted.where(F.col("band_code") >= threshold)
    found = teams.assignments(qualified, targets, components)
    taken = teams.assigned(found, targets).select("capability", "person")
    text = lambda c: c.cast("string")
    row = lambda section, subject, detail, value: (F.lit(section).alias("section"), text(subject).alias("subject"), text(detail).alias("detail"), value.cast("long").alias("value"))
    some = taken.where("person IS NOT NULL")
    touched = some.join(components, "capability").groupBy("person").agg(F.countDistinct("component").alias("n"))
    members = ordinal.rationales(qualified, some).join(touched, "person", "left")
    uncovered = taken.where("person IS NULL").select("capability")
    open_ = uncovered.join(ordinal.why_open(teams.closest_candidates(wanted, uncovered)), "capability", "left")
    objective = found.select(F.when(F.col("place") == 1, "best").otherwise("runner-up").alias("which"), F.explode(F.create_map(*(
        x for name in teams.OBJECTIVE for x in (F.lit(name), F.col(name).cast("long"))))).alias("name", "n"))
    parts = (
        targets.select(*row("target", F.col("capability"), F.lit(None), F.lit(None))),
        members.select(*row("member", F.col("person"), F.col("rationale"), F.coalesce("n", F.lit(0)))),
        open_.select(*row("residual", F.col("capability"), F.coalesce("why", F.format_string("Nobody holds any evidence for %s", "capability")), F.lit(None))),
        teams.greedy_picks(qualified).select(*row("greedy", F.col("pick"), F.col("person"), F.col("gained"))),
        objective.select(*row("objective", F.col("which"), F.col("name"), F.col("n"))),
        teams.uniqueness(found).select(*row("unique", F.lit("best"), F.lit(None), F.col("is_unique").cast("int"))),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(targets.limit(1).select(F.lit(1).alias("_some")), F.lit(True), "left_semi")
