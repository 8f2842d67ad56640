"""Plans of the continuous scores and of absence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, measures
from ..operators import absence, scoring
from ..sources import sinks
from .bindings import ABSENT, BAND, EVIDENCE, LINE_DAY, SCORES, TOKENS, day, evidence
from .registry import plan, read


def contributions(spark, d):
    return scoring.contributions(evidence(spark, d), day(LINE_DAY))


def scores(spark, d):
    return scoring.employee_skills(contributions(spark, d))


@plan("qry01_evidence_scoring", f"""
    WITH {SCORES} SELECT employee_id, capability_id, score, evidence_count, first_day, last_day, {BAND.format('score')} AS band FROM sc
""")
def qry01(spark, d):
    return scores(spark, d).select(
        "employee_id", "capability_id", "score", "evidence_count", F.col("first_demonstrated").alias("first_day"),
        F.col("last_demonstrated").alias("last_day"), "band",
    )


@plan("agg01_noisy_or", f"WITH {SCORES} SELECT employee_id, capability_id, score FROM sc")
def agg01(spark, d):
    return scores(spark, d).select("employee_id", "capability_id", "score")


@plan("agg01_capped_sum", f"""
    WITH {EVIDENCE} SELECT employee_id, capability_id, round_even(least(1.0, sum(contribution) * 0.5), 6) AS score
    FROM con GROUP BY employee_id, capability_id
""")
def agg01_capped(spark, d):
    return scoring.employee_skills(contributions(spark, d), "capped_sum").select("employee_id", "capability_id", "score")


@plan("agg02_timeline", f"""
    WITH {EVIDENCE} SELECT employee_id, capability_id, count(*) AS n,
        string_agg(CAST(day AS VARCHAR) || ':' || evidence_id, ',' ORDER BY day, evidence_id, contribution) AS timeline
    FROM con GROUP BY employee_id, capability_id
""")
def agg02(spark, d):
    entry = F.transform("timeline", lambda t: F.concat_ws(":", t["day"].cast("string"), t["evidence_id"].cast("string")))
    return scores(spark, d).select(
        "employee_id", "capability_id", F.col("evidence_count").alias("n"), F.array_join(entry, ",").alias("timeline")
    )


@plan("agg03_score_bands", f"WITH {SCORES} SELECT {BAND.format('score')} AS band, count(*) AS n FROM sc GROUP BY 1")
def agg03(spark, d):
    return scores(spark, d).groupBy("band").agg(F.count("*").alias("n"))


@plan("agg04_employee_summary", f"""
    WITH {SCORES} SELECT employee_id, count(*) AS n,
        string_agg(capability_id, ',' ORDER BY score DESC, capability_id) AS skills FROM sc GROUP BY employee_id
""")
def agg04(spark, d):
    names = F.array_join(F.transform("skills", lambda s: s["capability_id"]), ",")
    return scoring.summary(scores(spark, d)).select("employee_id", F.size("skills").cast("bigint").alias("n"), names.alias("skills"))


@plan("agg21_absence", f"""
    WITH {SCORES} SELECT capability_id, max(score) AS before,
        coalesce(max(score) FILTER (WHERE employee_id NOT IN (1, 3, 7)), 0.0) AS after,
        coalesce(max(score) FILTER (WHERE employee_id IN (1, 3, 7)), 0.0) AS absent_best,
        count(*) FILTER (WHERE employee_id NOT IN (1, 3, 7) AND score > 0) AS remaining
    FROM sc GROUP BY capability_id
""")
def agg21(spark, d):
    return absence.simulate(scores(spark, d), ABSENT).select("capability_id", "before", "after", "absent_best", "remaining")


@plan("qry13_multi_absence", f"""
    WITH {SCORES}, m AS (
        SELECT capability_id, max(score) AS b, coalesce(max(score) FILTER (WHERE employee_id NOT IN (1, 3, 7)), 0.0) AS a
        FROM sc GROUP BY capability_id
    )
    SELECT capability_id, {BAND.format('b')} AS before_band, {BAND.format('a')} AS after_band,
        CASE WHEN b > 0 AND a = 0 THEN 'Lost' WHEN a < b THEN 'Degraded' ELSE 'Maintained' END AS status,
        {BAND.format('a')} IN ('LOW', 'NONE') AS gap FROM m
""")
def qry13(spark, d):
    return absence.simulate(scores(spark, d), ABSENT).select("capability_id", "before_band", "after_band", "status", "gap")


@plan("srt04_gaps", f"""
    WITH {SCORES}, m AS (
        SELECT capability_id, coalesce(max(score) FILTER (WHERE employee_id NOT IN (1, 3, 7)), 0.0) AS after
        FROM sc GROUP BY capability_id
    )
    SELECT capability_id, after FROM m WHERE after < 0.45
""")
def srt04(spark, d):
    return absence.gaps(absence.simulate(scores(spark, d), ABSENT)).select("capability_id", "after")


@plan("agg22_evidence_by_source", f"""
    WITH {EVIDENCE}, c AS (SELECT capability_id, source, count(*) AS n FROM ev GROUP BY 1, 2)
    SELECT capability_id, string_agg(source || '=' || n, ',' ORDER BY source) AS sources FROM c GROUP BY 1
""")
def agg22(spark, d):
    pairs = F.array_sort(F.map_entries("evidence_by_source"))
    text = F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["value"].cast("string"))), ",")
    return absence.evidence_sources(evidence(spark, d)).select("capability_id", text.alias("sources"))


@plan("agg31_status_counts", f"""
    WITH {SCORES}, m AS (
        SELECT capability_id, max(score) AS b, coalesce(max(score) FILTER (WHERE employee_id NOT IN (1, 3, 7)), 0.0) AS a
        FROM sc GROUP BY capability_id
    )
    SELECT CASE WHEN b > 0 AND a = 0 THEN 'Lost' WHEN a < b THEN 'Degraded' ELSE 'Maintained' END AS status, count(*) AS n
    FROM m GROUP BY 1
""")
def agg31(spark, d):
    return absence.simulate(scores(spark, d), ABSENT).groupBy("status").agg(F.count("*").alias("n"))


@plan("dat02_recency", f"WITH {EVIDENCE} SELECT evidence_id, day, recency, count(*) AS n FROM rec GROUP BY 1, 2, 3")
def dat02(spark, d):
    rows = evidence(spark, d).withColumn("day", dates.parse_date(F.col("date")))
    rows = rows.withColumn("recency", dates.recency(F.col("day"), day(LINE_DAY)))
    return rows.groupBy("evidence_id", "day", "recency").agg(F.count("*").alias("n"))


@plan("mth01_contribution", f"WITH {EVIDENCE} SELECT evidence_id, contribution, count(*) AS n FROM con GROUP BY 1, 2")
def mth01(spark, d):
    return contributions(spark, d).groupBy("evidence_id", "contribution").agg(F.count("*").alias("n"))


@plan("mth02_strength", """
    SELECT event_id, coalesce(least(1.0, greatest(0.0, TRY_CAST(CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE
        CAST(value / 200 AS VARCHAR) END AS DOUBLE))), 0.5) AS strength FROM events
""")
def mth02(spark, d):
    raw = F.when(F.col("event_id") % 11 == 0, "n/a").otherwise((F.col("value") / 200).cast("string"))
    return read(spark, d, "events").select("event_id", measures.strength(raw).alias("strength"))


@plan("mth09_product_band", f"""
    WITH {EVIDENCE} SELECT {BAND.format('(least(1.0, score * 10) * recency)')} AS band, count(*) AS n FROM rec GROUP BY 1
""")
def mth09(spark, d):
    rows = contributions(spark, d)
    value = measures.product_band(F.least(F.lit(1.0), F.col("score") * 10), F.col("recency"))
    return rows.groupBy(value.alias("band")).agg(F.count("*").alias("n"))


@plan("win01_keep_last", """
    WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n,
                      min(event_id) OVER (PARTITION BY user_id) AS first_seen FROM events)
    SELECT user_id, event_id, event_type, first_seen FROM r WHERE n = 1
""")
def win01(spark, d):
    return scoring.keep_last(read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@plan("snk01_insert_if_absent", """
    SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 <> 1
    EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 3 = 1
""")
def snk01(spark, d):
    rows, keys = read(spark, d, "events"), ["user_id", "event_type"]
    return sinks.only_new(rows.where("event_id % 3 <> 1").select(*keys), rows.where("event_id % 3 = 1"), keys)


@plan("snk01_ingest_report", """
    WITH i AS (SELECT user_id, event_type FROM events WHERE event_id % 3 <> 1),
    n AS (SELECT DISTINCT user_id, event_type FROM i EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 3 = 1)
    SELECT (SELECT count(*) FROM i) AS fetched, (SELECT count(*) FROM n) AS inserted,
           (SELECT count(*) FROM i) - (SELECT count(*) FROM n) AS duplicate
""")
def snk01_report(spark, d):
    rows, keys = read(spark, d, "events"), ["user_id", "event_type"]
    return sinks.report(rows.where("event_id % 3 <> 1"), rows.where("event_id % 3 = 1"), keys)


@plan("snk03_upsert", f"""
    WITH {SCORES} SELECT employee_id, capability_id, CASE WHEN employee_id % 5 = 0 THEN 1.0 ELSE score END AS score FROM sc
""")
def snk03(spark, d):
    stored = scores(spark, d).select("employee_id", "capability_id", "score")
    new = stored.where("employee_id % 5 = 0").withColumn("score", F.lit(1.0))
    return sinks.upsert(stored, new, ["employee_id", "capability_id"])


@plan("set07_merge_manual", """
    SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'manual' ELSE 'auto' END AS status,
           CASE WHEN n_nationkey % 3 = 0 OR n_nationkey >= 20 THEN n_regionkey ELSE n_regionkey + 10 END AS service FROM nation
""")
def set07(spark, d):
    n = read(spark, d, "nation")
    state = F.when(F.col("n_nationkey") % 3 == 0, "manual").otherwise("auto")
    stored = n.select(F.col("n_nationkey").alias("k"), state.alias("status"), F.col("n_regionkey").alias("service"))
    new = stored.where("k < 20").select("k", F.lit("auto").alias("status"), (F.col("service") + 10).alias("service"))
    return sinks.merge_manual(stored, new, "k")


@plan("joi03_skill_matches", f"""
    WITH b AS (SELECT DISTINCT p_brand FROM part), sk AS (SELECT p_brand AS capability_id, {TOKENS.format("p_brand || ' widget ring bolt gear'")} AS kw FROM b),
    mo AS (SELECT p_type, list_sort(list(DISTINCT p_brand))[1:2] AS caps FROM part GROUP BY 1),
    ev AS (SELECT p_partkey AS evidence_id, p_type, list_distinct(list_concat({TOKENS.format('p_name')}, {TOKENS.format('lower(p_brand)')})) AS t FROM part),
    x AS (SELECT evidence_id, capability_id, list_contains(caps, capability_id) AS st,
                 CASE WHEN least(len(t), len(kw)) > 0 THEN len(list_intersect(t, kw)) / least(len(t), len(kw)) ELSE 0 END AS o FROM ev JOIN mo USING (p_type) CROSS JOIN sk),
    m AS (SELECT evidence_id, capability_id, round_even(o, 6) AS overlap, CASE WHEN st THEN round_even(least(1.0, 0.75 + 0.25 * o), 4) ELSE round_even(least(0.6, 1.2 * o), 4) END AS relevance,
                 CASE WHEN st AND o > 0 THEN 'structural+textual' WHEN st THEN 'structural' ELSE 'textual_only' END AS match_type FROM x WHERE st OR o >= 0.12)
    SELECT evidence_id, capability_id, overlap, relevance, coalesce(match_type, 'none') AS match_type FROM ev LEFT JOIN m USING (evidence_id)
""")
def joi03(spark, d):
    brands = read(spark, d, "part").select(F.col("p_brand").alias("id")).distinct()
    skills = scoring.taxonomy(brands.select("id", F.col("id").alias("name"), F.lit("widget ring bolt gear").alias("description")))
    modules = read(spark, d, "part").groupBy(F.col("p_type").alias("module_id")).agg(
        F.slice(F.array_sort(F.collect_set("p_brand")), 1, 2).alias("capability_ids")
    )
    parts = read(spark, d, "part").select(
        F.col("p_partkey").alias("evidence_id"), F.col("p_type").alias("module_id"),
        F.col("p_name").alias("description"), F.lower("p_brand").alias("type"),
    )
    return scoring.skill_matches(parts, modules, skills).select("evidence_id", "capability_id", "overlap", "relevance", "match_type")
