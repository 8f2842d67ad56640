"""Ordinal bands: ceilings of each edge, best band of person by capability, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AUTHOR_ROLES, COVERAGE_THRESHOLD, FRESH_MONTHS, HIGH, LOW, MODERATE, ROLE_CEILINGS
from ..functions import dates, measures
from . import similarity


def role_ceilings(spark) -> DataFrame:
    return spark.createDataFrame(list(ROLE_CEILINGS), "source string, rung int, role string, role_cap int")


def _caps(caps: dict[str, Column]) -> Column:
    """The smallest cap and its name; ties to the first name in order of the alphabet."""
    return F.array_min(
        F.array(*(F.struct(F.coalesce(c, F.lit(HIGH)).cast("int").alias("band"), F.lit(n).alias("cap")) for n, c in caps.items()))
    )


def units(edges: DataFrame) -> DataFrame:
    """(unit, _breadth, unit_at): how many capabilities a unit's edges name, and the time of its latest item."""
    return edges.groupBy("unit").agg(F.countDistinct("capability").alias("_breadth"), F.max("occurred_at").alias("unit_at"))


def ceilings(edges: DataFrame, as_of: Column, p90: Column, p98: Column, p10: Column, known_units: DataFrame | None = None) -> DataFrame:
    """Adds ceiling, binding_cap and unit_at to edges (source, role, occurred_at, unit, capability, certainty, effort).

    An edge is as old as its work unit, whose time is that of its latest item. A
    role that isn't listed has the lowest cap; no effort signal is no cap.
    known_units: units() of the same edges, where they are made already.
    """
    breadth = units(edges) if known_units is None else known_units
    known = role_ceilings(edges.sparkSession).select("source", "role", "role_cap")
    wide = F.when(F.col("_breadth") > p98, LOW).when(F.col("_breadth") > p90, MODERATE).otherwise(HIGH)
    found = _caps(
        {
            "role": F.coalesce("role_cap", F.lit(0)),
            "age": dates.age_cap(F.col("unit_at"), as_of),
            "breadth": wide,
            "certainty": HIGH - measures.certainty_rank(F.col("certainty")),
            "substance": F.when(F.col("effort") < p10, LOW).otherwise(HIGH),
        }
    )
    return (
        edges.join(breadth, "unit")
        .join(F.broadcast(known), ["source", "role"], "left")
        .withColumn("_cap", found)
        .withColumns({"ceiling": F.col("_cap.band"), "binding_cap": F.col("_cap.cap")})
        .drop("_cap", "_breadth", "role_cap")
    )


def assign(edges: DataFrame, as_of: Column) -> DataFrame:
    """(person, capability, band_code, unit): best unit by ceiling, then authorship dominance.

    A person with more than one fresh authored unit and more than all others
    together is in the highest band. edges has item_id, person, capability, unit,
    role, unit_at, ceiling.
    """
    first = F.max(F.struct("ceiling", (-F.col("item_id")).alias("tie"), "unit"))
    fresh = F.col("role").isin(*AUTHOR_ROLES) & (dates.months(F.col("unit_at"), as_of) <= FRESH_MONTHS)
    # the band beside the struct: where no unit is asked for, no struct is made
    found = edges.groupBy("person", "capability").agg(
        F.max("ceiling").alias("best"), first.alias("top"), F.countDistinct(F.when(fresh, F.col("unit"))).alias("mine")
    )
    others = F.sum("mine").over(Window.partitionBy("capability")) - F.col("mine")
    named = F.col("person").isNotNull() & F.col("capability").isNotNull()
    dominant = (F.col("mine") > 1) & (F.col("mine") > F.col("others")) & named
    return found.withColumn("others", others).select(
        "person", "capability",
        F.when(dominant, HIGH).otherwise(F.col("best")).alias("band_code"),
        F.col("top.unit").alias("unit"), dominant.alias("dominant"),
    )


def grid(people: DataFrame, capabilities: DataFrame, bands: DataFrame) -> DataFrame:
    """Every active person by every capability; pairs without edges are in the lowest band.

    Both sides are dimensions; the grid is their size, which is the result.
    """
    pairs = people.select("person").crossJoin(capabilities.select("capability"))
    return pairs.join(bands, ["person", "capability"], "left").withColumn("band_code", F.coalesce("band_code", F.lit(0)))


def coverage(bands: DataFrame, threshold: int = COVERAGE_THRESHOLD) -> DataFrame:
    """Capability: coverers, best band and its first holder by name; one pass over the bands."""
    covers = F.col("band_code") >= threshold
    top = F.min(F.struct((-F.col("band_code")).alias("worst"), "person"))
    return bands.groupBy("capability").agg(
        F.count_if(covers).alias("n_coverers"),
        F.array_sort(F.collect_list(F.when(covers, F.col("person")))).alias("coverers"),
        F.max("band_code").alias("best_band"),
        F.when(F.max("band_code") > 0, top["person"]).alias("best_holder"),
    )


def at_risk(covered: DataFrame) -> DataFrame:
    """Capabilities of no coverer, or one."""
    return covered.where("n_coverers <= 1").withColumn("risk", F.when(F.col("n_coverers") == 0, "uncovered").otherwise("single"))


def absence(bands: DataFrame, person, threshold: int = COVERAGE_THRESHOLD) -> DataFrame:
    """Capability: coverers and best band with and without a person, and the status in the order of its rules."""
    here = F.col("person") != F.lit(person)
    covers = F.col("band_code") >= threshold
    out = bands.groupBy("capability").agg(
        F.count_if(covers).alias("before"), F.count_if(covers & here).alias("after"),
        F.max("band_code").alias("best_before"), F.coalesce(F.max(F.when(here, F.col("band_code"))), F.lit(0)).alias("best_after"),
    )
    state = (
        F.when((F.col("before") == 0) & (F.col("after") == 0), "Uncovered")
        .when((F.col("before") > 0) & (F.col("after") == 0), "Lost")
        .when((F.col("after") < F.col("before")) | (F.col("best_after") < F.col("best_before")), "Degraded")
        .otherwise("Maintained")
    )
    return out.withColumn("status", state)


def unit_times(edges: DataFrame) -> DataFrame:
    """(unit, unit_at): the time of a unit's latest item."""
    return edges.groupBy("unit").agg(F.max("occurred_at").alias("unit_at"))


def activity(edges: DataFrame, as_of: Column, thin: int) -> DataFrame:
    """Capability: whether any unit is fresh, and whether it has fewer units than thin."""
    units = edges.select("capability", "unit").distinct().join(unit_times(edges), "unit")
    return units.groupBy("capability").agg(
        F.bool_or(dates.months(F.col("unit_at"), as_of) <= FRESH_MONTHS).alias("active"),
        (F.count("*") < thin).alias("is_thin"),
    )


def thresholds(edges: DataFrame, known_units: DataFrame) -> DataFrame:
    """One row: nearest ranks of effort and of the breadths of units() of the edges."""
    effort = similarity.nearest_ranks(edges.where("effort > 0"), (), "effort", p10_effort=0.10)
    breadth = similarity.nearest_ranks(known_units, (), "_breadth", p90_breadth=0.90, p98_breadth=0.98)
    return effort.crossJoin(F.broadcast(breadth))  # of one row each


def calibration(edges: DataFrame) -> DataFrame:
    """One row: the latest day, and nearest ranks of effort, of capabilities a unit and of units a capability."""
    deep = edges.groupBy("capability").agg(F.countDistinct("unit").alias("n"))
    density = similarity.nearest_ranks(deep, (), "n", p25_units=0.25)
    last = edges.agg(F.max("occurred_at").alias("as_of"))
    for row in (thresholds(edges, units(edges)), density):  # of one row each
        last = last.crossJoin(F.broadcast(row))
    return last


def holders(bands: DataFrame, departed: Column) -> DataFrame:
    """Those with any band in a capability, the departed apart, in order of band and name."""
    held = bands.where("band_code > 0").withColumn("departed", departed)
    w = Window.partitionBy("capability", "departed").orderBy(F.desc("band_code"), "person")
    return held.withColumn("place", F.row_number().over(w)).select("capability", "person", "band_code", "departed", "place")


def sole_coverers(covered: DataFrame) -> DataFrame:
    """(person, capability) where nobody else covers."""
    return covered.where("n_coverers = 1").select(F.col("coverers")[0].alias("person"), "capability")


def overview(bands: DataFrame, edges: DataFrame, as_of: Column, thin: int, threshold: int = COVERAGE_THRESHOLD) -> DataFrame:
    """Each capability's coverage, activity and density, and its state in words."""
    out = coverage(bands, threshold).join(activity(edges, as_of, thin), "capability")
    state = F.when(F.col("n_coverers") == 0, "uncovered").when(F.col("n_coverers") == 1, "single").otherwise("covered")
    shown = F.concat_ws(", ", state, F.when(~F.col("active"), "dormant"), F.when(F.col("is_thin"), "thin"))
    return out.withColumn("state", shown)


def risk_headline(covered: DataFrame) -> DataFrame:
    """One sentence on capabilities without a coverer and with one."""
    n = covered.agg(F.count_if(F.col("n_coverers") == 0).alias("none"), F.count_if(F.col("n_coverers") == 1).alias("one"), F.count("*").alias("all"))
    text = F.format_string("%d uncovered and %d with a single coverer of %d capabilities", "none", "one", "all")
    return n.select(text.alias("headline"))


def departure_targets(bands: DataFrame, person, threshold: int = COVERAGE_THRESHOLD) -> DataFrame:
    """What a person covers."""
    return bands.where((F.col("person") == F.lit(person)) & (F.col("band_code") >= threshold)).select("capability")


def candidate_matrix(bands: DataFrame, people: DataFrame, targets: DataFrame, leaving, threshold: int = COVERAGE_THRESHOLD) -> DataFrame:
    """Everybody who stays by every target: the band, none without evidence, and whether it qualifies."""
    stay = people.where(F.col("person") != F.lit(leaving))
    return grid(stay, targets, bands.select("person", "capability", "band_code")).withColumn("qualified", F.col("band_code") >= threshold)


def rationales(bands: DataFrame, assigned: DataFrame) -> DataFrame:
    """(person, rationale): what each person takes over, with the band held, in order of the capability."""
    names = F.element_at(F.array(*map(F.lit, ("NONE", "LOW", "MODERATE", "HIGH"))), F.col("band_code") + 1)
    lines = assigned.join(bands, ["person", "capability"]).select("person", F.struct("capability", F.concat_ws(" at ", "capability", names).alias("line")).alias("one"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda o: o["line"]), "; ")
    return lines.groupBy("person").agg(listed.alias("rationale"))


def why_open(closest: DataFrame) -> DataFrame:
    """(capability, why): a sentence on the nearest candidate of a capability that nobody covers."""
    names = F.element_at(F.array(*map(F.lit, ("NONE", "LOW", "MODERATE", "HIGH"))), F.col("band_code") + 1)
    text = F.format_string("Nobody covers %s; closest is %s at %s", F.col("capability"), F.col("person").cast("string"), names)
    return closest.select("capability", text.alias("why"))
