"""Plans of records: validation, rules, links, explanations, incidents of a paging service."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import absence, records, reporting, scoring
from .bindings import ABSENT, BAND, EVIDENCE, LINE_DAY, SCORES, day, evidence
from .registry import plan, read
from .scores import contributions, scores


@plan("qry02_incremental", f"WITH {SCORES} SELECT employee_id, capability_id, score, evidence_count FROM sc")
def qry02(spark, d):
    """Old evidence and new together: the scores are those of all of it."""
    rows = evidence(spark, d)
    old, new = rows.where("evidence_id % 3 > 0"), rows.where("evidence_id % 3 = 0")
    whole = scoring.contributions(old.unionByName(new), day(LINE_DAY))
    return scoring.employee_skills(whole).select("employee_id", "capability_id", "score", "evidence_count")


@plan("qry03_evidence_level", f"WITH {EVIDENCE} SELECT evidence_id, employee_id, capability_id, recency, contribution FROM con")
def qry03(spark, d):
    return contributions(spark, d).select("evidence_id", "employee_id", "capability_id", "recency", "contribution")


@plan("str28_explanations", f"""
    WITH {SCORES} SELECT employee_id, capability_id, employee_id || ' has ' || {BAND.format('score')} || ' credibility (' || format('{{:.6f}}', score) || ') for ''' || capability_id ||
        ''' based on ' || evidence_count || ' piece(s) of evidence spanning ' || first_day || ' to ' || last_day || '. Aggregation method: noisy_or.' AS explanation FROM sc
""")
def str28(spark, d):
    return records.explanations(scores(spark, d))


@plan("str25_gap_sentences", f"""
    WITH {SCORES}, m AS (SELECT capability_id, max(score) AS b, coalesce(max(score) FILTER (WHERE employee_id NOT IN (1, 3, 7)), 0.0) AS a FROM sc GROUP BY 1),
    n AS (SELECT *, {BAND.format('b')} AS bb, {BAND.format('a')} AS ab FROM m)
    SELECT capability_id, CASE WHEN a >= 0.45 THEN 'Coverage remains ' || ab || ' (' || format('{{:.2f}}', a) || ').'
        ELSE CASE WHEN ab = 'NONE' THEN 'Nobody who remains covers this capability.' ELSE 'Residual coverage only (' || ab || ', ' || format('{{:.2f}}', a) || ').' END
        || CASE WHEN bb <> ab THEN ' Coverage fell from ' || bb || ' (' || format('{{:.2f}}', b) || ') to ' || ab || ' (' || format('{{:.2f}}', a) || ').' ELSE ' It was at ' || bb || ' already.' END
        END AS sentence FROM n
""")
def str25(spark, d):
    return records.gap_sentences(absence.simulate(scores(spark, d), ABSENT))


@plan("flt03_validation", """
    WITH r AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN 'e' || (event_id % 600) END AS id, CASE WHEN user_id % 9 > 0 THEN 'u' || user_id END AS emp,
        CASE WHEN event_id % 4 > 0 THEN 'text' ELSE ' ' END AS descr, event_type AS type, CASE WHEN event_id % 5 > 0 THEN 'm' END AS module FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) > 1 AND id IS NOT NULL AS dup FROM r)
    SELECT event_id, emp IS NULL AS fatal, concat_ws(',', CASE WHEN id IS NULL THEN 'missing_evidence_id' WHEN dup THEN 'duplicate_evidence_id' END, CASE WHEN emp IS NULL THEN 'missing_employee_id' END,
        CASE WHEN trim(descr) = '' THEN 'empty_description' END, CASE WHEN type NOT IN ('view', 'click') THEN 'unknown_evidence_type' END, CASE WHEN module IS NULL THEN 'missing_module_id' END) AS warnings FROM n
""")
def flt03(spark, d):
    i = F.col("event_id")
    rows = read(spark, d, "events").select(
        "event_id", F.when(i % 11 > 0, F.concat(F.lit("e"), i % 600)).alias("id"), F.when(F.col("user_id") % 9 > 0, F.concat(F.lit("u"), "user_id")).alias("employee_id"),
        F.when(i % 4 > 0, "text").otherwise(" ").alias("description"), F.col("event_type").alias("type"), F.when(i % 5 > 0, "m").alias("module_id"),
    )
    found = records.validated(records.duplicates(rows, "id", "event_id"), ("view", "click"))
    return found.select("event_id", "fatal", F.array_join("warnings", ",").alias("warnings"))


@plan("win02_duplicates", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS is_duplicate FROM events")
def win02(spark, d):
    return records.duplicates(read(spark, d, "events"), "user_id", "event_id").select("event_id", "is_duplicate")


@plan("joi05_label_modules", """
    SELECT DISTINCT event_id, 'm-' || lower(event_type) AS module_id FROM events WHERE event_type IN ('view', 'click')
""")
def joi05(spark, d):
    events = read(spark, d, "events").select("event_id", F.array(F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")), F.col("event_type"), F.lit("none")).alias("labels"))
    rules = spark.createDataFrame([("View ", "m-view"), ("CLICK", "m-click")], "label string, module_id string")
    return records.label_modules(events, rules)


@plan("set03_module_union", "SELECT event_id, 'm' || (event_id % 3) AS module_id FROM events UNION SELECT event_id, 'm' || (user_id % 3) FROM events WHERE event_type = 'view'")
def set03(spark, d):
    e = read(spark, d, "events")
    files = e.select("event_id", F.concat(F.lit("m"), F.col("event_id") % 3).alias("module_id"))
    return records.module_sets(files, e.where("event_type = 'view'").select("event_id", F.concat(F.lit("m"), F.col("user_id") % 3).alias("module_id")))


@plan("set06_distinct_pairs", "SELECT DISTINCT l_suppkey AS employee_id, p_brand AS capability_id FROM lineitem JOIN part ON l_partkey = p_partkey")
def set06(spark, d):
    return evidence(spark, d).select("employee_id", "capability_id").distinct()


@plan("set09_label_rules", """
    WITH u AS (SELECT lower(p_brand) AS label, 'jira' || p_size % 3 AS module_id, 'jira' AS origin, 0 AS r FROM part UNION ALL SELECT lower(p_brand), 'name', 'module', 1 FROM part WHERE p_brand LIKE '%1'
        UNION ALL SELECT lower(p_brand), 'hand', 'curated', 2 FROM part WHERE p_brand LIKE '%11'),
    n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY r DESC, module_id) AS n FROM u) SELECT label, module_id, origin FROM n WHERE n = 1
""")
def set09(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("label"), "p_size")
    named = p.where(F.col("label").like("%1")).select("label", F.lit("name").alias("module_id"))
    return records.label_rules({
        "jira": p.select("label", F.concat(F.lit("jira"), F.col("p_size") % 3).alias("module_id")), "module": named,
        "curated": p.where(F.col("label").like("%11")).select("label", F.lit("hand").alias("module_id")),
    })


@plan("set10_difference", """
    (SELECT s_suppkey AS id, 'unexpected' AS side FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 > 0) UNION ALL (SELECT s_suppkey, 'missing' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 > 0)
""")
def set10(spark, d):
    ids = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return records.difference(ids.where("id % 2 = 0"), ids.where("id % 3 = 0"))


@plan("set08_resolved_spaces", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 AND s_suppkey % 3 < 2 THEN true ELSE false END AS resolved FROM supplier
""")
def set08(spark, d):
    k = F.col("s_suppkey")
    rows = read(spark, d, "supplier").select("s_suppkey", F.when(k % 4 > 0, "svc").alias("service"), F.when(k % 3 == 0, "manual").when(k % 3 == 1, "auto").otherwise("ambiguous").alias("status"))
    return records.mapping_state(rows).select("s_suppkey", "resolved")


@plan("flt12_wanted_spaces", "SELECT n_name AS space_key FROM nation WHERE upper(n_name) IN (SELECT upper(n_name) FROM nation WHERE n_nationkey < 2)")
def flt12(spark, d):
    rows = read(spark, d, "nation").select(F.col("n_name").alias("space_key"), "n_nationkey")
    keys = tuple(r.space_key.lower() for r in rows.where("n_nationkey < 2").collect())  # two configured keys
    return records.wanted_spaces(rows, keys).select("space_key")


@plan("flt13_automation", """
    SELECT event_id, event_id % 6 IN (0, 2, 4) AS automation FROM events
""")
def flt13(spark, d):
    k = F.col("event_id") % 6
    name = F.when(k == 0, "Dependabot[bot]").when(k == 1, "ann@x.org").when(k == 2, " NoReply@x.org").when(k == 3, "botany@x.org").when(k == 4, "ci")
    return read(spark, d, "events").select("event_id", records.like_automation(name).alias("automation"))


@plan("flt14_graph_links", f"""
    WITH {SCORES}, s AS (SELECT * FROM sc WHERE employee_id % 4 > 0)
    SELECT employee_id, capability_id, score AS weight FROM s WHERE score > 0
    UNION ALL SELECT DISTINCT employee_id, capability_id, 0.5::DOUBLE FROM ev WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.employee_id = ev.employee_id AND s.capability_id = ev.capability_id)
""")
def flt14(spark, d):
    return records.graph_links(scores(spark, d).where("employee_id % 4 > 0"), evidence(spark, d))


@plan("joi22_service_capabilities", "SELECT DISTINCT p_type AS service, p_brand AS capability_id FROM part")
def joi22(spark, d):
    p = read(spark, d, "part")
    return records.service_capabilities(p.select(F.col("p_type").alias("service"), F.col("p_partkey").alias("module_id")), p.select(F.col("p_partkey").alias("module_id"), F.col("p_brand").alias("capability_id")))


@plan("joi24_module_context", "SELECT p_brand AS capability_id, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS modules, count(*) AS n FROM part GROUP BY 1")
def joi24(spark, d):
    return reporting.module_context(read(spark, d, "part").select(F.col("p_brand").alias("capability_id"), F.col("p_type").alias("module")))


@plan("joi26_profiles", f"""
    WITH {SCORES} SELECT s_suppkey AS employee_id, s_name AS name, count(capability_id) AS n, coalesce(string_agg(capability_id || ':' || {BAND.format('score')}, ',' ORDER BY capability_id), '') AS held
    FROM supplier LEFT JOIN sc ON employee_id = s_suppkey GROUP BY 1, 2
""")
def joi26(spark, d):
    people = read(spark, d, "supplier").select(F.col("s_suppkey").alias("employee_id"), F.col("s_name").alias("name"))
    found = records.employee_profiles(people, scores(spark, d))
    held = F.array_join(F.transform("capabilities", lambda c: F.concat_ws(":", c["capability_id"], c["band"])), ",")
    return found.select("employee_id", "name", F.size("capabilities").cast("bigint").alias("n"), held.alias("held"))


@plan("prj14_paging_incidents", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'inner ' || event_id WHEN event_id % 3 = 1 THEN 'outer' ELSE 'Untitled incident' END AS title, 'svc' AS service,
        CASE WHEN event_id % 3 = 0 THEN 'SEV-2' WHEN event_id % 2 = 0 THEN 'SEV-1' ELSE 'SEV-3' END AS severity, '2024-01-01' AS timestamp FROM events
""")
def prj14(spark, d):
    i = F.col("event_id")
    inner = F.struct(F.concat(F.lit("inner "), i.cast("string")).alias("title"), F.lit("SEV-2").alias("severity"), F.lit("2024-01-01").alias("timestamp"))
    payload = F.to_json(F.struct(
        F.when(i % 3 == 0, F.struct(inner.alias("details"))).alias("body"), F.when(i % 3 == 1, "outer").otherwise(" ").alias("title"),
        F.struct(F.lit("svc").alias("id")).alias("service"), F.when(i % 2 == 0, "high").otherwise("low").alias("urgency"), F.lit("2024-01-01").alias("created_at"),
    ))
    return read(spark, d, "events").select("event_id", records.incident_event(payload).alias("e")).select("event_id", "e.*")


@plan("prj15_incident_details", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS place FROM events
""")
def prj15(spark, d):
    k = F.col("event_id") % 4
    payload = F.when(k == 0, '{"first_trigger_log_entry": {"channel": {"details": {"p": "a"}}}, "details": {"p": "b"}}').when(k == 1, '{"first_trigger_log_entry": {"channel": {"details": {}}}, "details": {"p": "b"}}')
    payload = payload.when(k == 2, '{"details": "text", "body": {"details": {"p": "c"}}}').otherwise('{"details": {}}')
    return read(spark, d, "events").select("event_id", F.get_json_object(records.incident_details(payload), "$.p").alias("place"))


@plan("prj16_incident_people", """
    SELECT event_id AS incident_id, CASE event_id % 5 WHEN 0 THEN 'lead' WHEN 1 THEN 'E-mail' WHEN 2 THEN 'E-name' WHEN 3 THEN 'E-id' END AS employee_id FROM events
""")
def prj16(spark, d):
    k = F.col("event_id") % 5
    rows = read(spark, d, "events").select(
        F.col("event_id").alias("incident_id"), F.when(k == 0, "lead").alias("lead_id"), F.when(k == 1, "Mail@x.org").otherwise("other@x.org").alias("email"),
        F.when((k == 1) | (k == 2), "Ann Name").otherwise("nobody").alias("name"), F.when(k < 4, "ID7").otherwise("ID9").alias("native_id"),
    )
    handles = spark.createDataFrame([("mail@x.org", "E-mail"), ("ann name", "E-name"), ("id7", "E-id")], "handle string, employee_id string")
    return records.incident_people(rows, handles)
