"""The test tables in the roles that the operators expect, and the same roles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import read

#: Days of reference: the day after the last shipment, and after the last event.
LINE_DAY, EVENT_DAY = "2001-11-05", "2024-02-01"
ABSENT = [1, 3, 7]


def day(text: str):
    return F.lit(text).cast("date")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as employees, brands as capabilities, part types as modules."""
    parts = read(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return read(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"),
        F.col("l_suppkey").alias("employee_id"), F.col("p_brand").alias("capability_id"),
        F.col("p_type").alias("module_id"), F.col("p_name").alias("description"),
        F.col("l_returnflag").alias("source"), F.col("l_shipdate").cast("date").cast("string").alias("date"),
        F.col("l_discount").alias("score"), F.lit(0.75).alias("relevance"),
    )


EVIDENCE = """
    ev AS (
        SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_suppkey AS employee_id, p_brand AS capability_id,
               p_type AS module_id, p_name AS description, l_returnflag AS source, CAST(l_shipdate AS DATE) AS day,
               l_discount AS score
        FROM lineitem JOIN part ON l_partkey = p_partkey
    ),
    rec AS (
        SELECT *, round_even(exp(-0.35 * greatest(date_diff('day', day, DATE '2001-11-05'), 0) / 365.0), 6) AS recency
        FROM ev
    ),
    con AS (SELECT *, round_even(score * 0.75 * recency, 6) AS contribution FROM rec)
"""
SCORES = f"""{EVIDENCE},
    sc AS (
        SELECT employee_id, capability_id, round_even(1 - product(1 - contribution), 6) AS score,
               count(*) AS evidence_count, min(day) AS first_day, max(day) AS last_day
        FROM con GROUP BY employee_id, capability_id
    )
"""
BAND = "CASE WHEN {0} >= 0.75 THEN 'HIGH' WHEN {0} >= 0.45 THEN 'MODERATE' WHEN {0} >= 0.2 THEN 'LOW' ELSE 'NONE' END"


def edges(spark: SparkSession, d: str, capability: str = "p_brand") -> DataFrame:
    """Line items as items, orders as work units, return flags as certainty; brands, or another column, as capabilities."""
    parts = read(spark, d, "part").select("p_partkey", capability) if capability != "p_partkey" else read(spark, d, "part").select("p_partkey")
    certainty = F.when(F.col("l_returnflag") == "A", "certain").when(F.col("l_returnflag") == "N", "probable").otherwise("tentative")
    role = F.when(F.col("l_linestatus") == "F", "author").when(F.col("l_linenumber") < 3, "pr_author").otherwise("reviewer_approval")
    return read(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.col("l_suppkey").alias("person"),
        F.col(capability).alias("capability"), F.col("l_orderkey").alias("unit"), F.lit("github").alias("source"),
        role.alias("role"), certainty.alias("certainty"), F.col("l_shipdate").cast("date").alias("occurred_at"),
        F.nullif("l_quantity", F.lit(1.0)).alias("effort"),
    )


def edges_sql(p90="5", p98="7", p10="5", capability="p_brand", before="") -> str:
    """The same edges, units, ceilings and bands in SQL."""
    return f"""
    e AS (
        SELECT l_orderkey * 10 + l_linenumber AS item_id, l_suppkey AS person, {capability} AS capability, l_orderkey AS unit,
               CASE WHEN l_linestatus = 'F' THEN 'author' WHEN l_linenumber < 3 THEN 'pr_author' ELSE 'reviewer_approval' END AS role,
               CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS certainty_cap,
               CAST(l_shipdate AS DATE) AS occurred_at, nullif(l_quantity, 1) AS effort
        FROM lineitem JOIN part ON l_partkey = p_partkey
    ),
    br AS (SELECT unit, count(DISTINCT capability) AS breadth, max(occurred_at) AS unit_at FROM e GROUP BY unit),{before}
    caps AS (
        SELECT e.*, unit_at, CASE role WHEN 'reviewer_approval' THEN 1 ELSE 2 END AS role_cap,
               CASE WHEN date_diff('day', unit_at, DATE '2001-11-05') / 30.44 <= 12 THEN 3
                    WHEN date_diff('day', unit_at, DATE '2001-11-05') / 30.44 <= 24 THEN 2 ELSE 1 END AS age_cap,
               CASE WHEN breadth > {p98} THEN 1 WHEN breadth > {p90} THEN 2 ELSE 3 END AS breadth_cap,
               CASE WHEN effort < {p10} THEN 1 ELSE 3 END AS substance_cap
        FROM e JOIN br USING (unit)
    ),
    cl AS (SELECT *, least(role_cap, age_cap, breadth_cap, certainty_cap, substance_cap) AS ceiling FROM caps),
    u AS (SELECT person, capability, unit, max(ceiling) AS c FROM cl GROUP BY person, capability, unit),
    best AS (SELECT person, capability, max(c) AS c FROM u GROUP BY person, capability),
    fresh AS (
        SELECT capability, person, count(DISTINCT unit) AS mine FROM cl
        WHERE role IN ('author', 'pr_author') AND date_diff('day', unit_at, DATE '2001-11-05') / 30.44 <= 12
        GROUP BY capability, person
    ),
    dom AS (
        SELECT person, capability FROM (SELECT *, sum(mine) OVER (PARTITION BY capability) - mine AS others FROM fresh)
        WHERE mine > 1 AND mine > others
    ),
    bd AS (
        SELECT b.person, b.capability, CASE WHEN d.person IS NOT NULL THEN 3 ELSE b.c END AS band_code,
               d.person IS NOT NULL AS dominant
        FROM best b LEFT JOIN dom d ON b.person = d.person AND b.capability = d.capability
    )
"""


EDGES = edges_sql()


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Nations as components: nation n depends on (7 n + 3) mod 25 and n / 2."""
    n = F.col("n_nationkey")
    rows = read(spark, d, "nation")
    return rows.select(n.alias("source"), F.explode(F.array((n * 7 + 3) % 25, F.floor(n / 2).cast("int"))).alias("target")).where(
        "source <> target"
    )


DEPENDENCIES = """
    dep AS (
        SELECT n_nationkey AS source, (n_nationkey * 7 + 3) % 25 AS target FROM nation
        UNION ALL SELECT n_nationkey, n_nationkey // 2 FROM nation
    ),
    de AS (SELECT DISTINCT source, target FROM dep WHERE source <> target)
"""


def signatures(spark: SparkSession, d: str) -> DataFrame:
    """Parts as items: the tokens of name, brand and type."""
    from ..functions import text

    return read(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"), F.lit("part").alias("source"),
        text.tokens(F.concat_ws(" ", "p_name", "p_brand", F.lower("p_type"))).alias("signature"),
    )


TOKENS = (
    "list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[a-zA-Z0-9+/#.\\-]+'),"
    " lambda t: lower(trim(t, '.,;:()'))), lambda t: length(t) > 2 AND t NOT IN ("
    "'a','an','the','and','or','for','of','to','in','on','with','is','are','was','were','be','been','this','that','it',"
    "'as','at','by','from','into','across','during','after','over','up')))"
)
