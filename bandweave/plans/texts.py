"""Plans of text, date and event functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, measures, text
from ..operators import events, normalize, reporting
from ..sources import files
from .bindings import EVENT_DAY, LINE_DAY, TOKENS, day
from .registry import plan, read

_JOINED = "list_aggregate(list_sort({0}), 'string_agg', ' ')"


@plan("str01_tokens", f"""
    WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS toks FROM documents)
    SELECT doc_id, len(toks)::BIGINT AS n, sha256(coalesce({_JOINED.format('toks')}, '')) AS digest FROM t
""")
def str01(spark, d):
    t = text.tokens(F.col("text"))
    return read(spark, d, "documents").select(
        "doc_id", F.size(t).cast("bigint").alias("n"), F.sha2(F.array_join(F.array_sort(t), " "), 256).alias("digest")
    )


@plan("str04_slug", """
    SELECT c_custkey, trim(regexp_replace(lower(trim(c_name || ' / ' || c_mktsegment)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer
""")
def str04(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.slug(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("slug"))


@plan("str05_space_slug", """
    SELECT o_orderkey, array_to_string(regexp_split_to_array(lower(trim(o_orderpriority)), '\\s+'), '-') AS slug FROM orders
""")
def str05(spark, d):
    return read(spark, d, "orders").select("o_orderkey", text.space_slug(F.col("o_orderpriority")).alias("slug"))


@plan("str06_ticket_keys", """
    WITH m AS (SELECT o_orderkey, 'Closes PAY-' || o_custkey || ', see OPS-' || (o_orderkey % 97) || ' XPAY-1 PAY-' || o_custkey AS msg FROM orders)
    SELECT o_orderkey, array_to_string(list_sort(list_distinct(regexp_extract_all(msg, '\\b(?:PAY|JIRA|ENG|OPS)-\\d+\\b'))), ',') AS keys FROM m
""")
def str06(spark, d):
    key, order = F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 97).cast("string")
    msg = F.concat(F.lit("Closes PAY-"), key, F.lit(", see OPS-"), order, F.lit(" XPAY-1 PAY-"), key)
    return read(spark, d, "orders").select("o_orderkey", F.array_join(text.ticket_keys(msg), ",").alias("keys"))


@plan("str07_emails", """
    SELECT s_suppkey, regexp_replace(lower(trim(' ' || replace(s_name, '#', '+') || '@Example.COM ')), '\\+[^@]*@', '@', 'g') AS email FROM supplier
""")
def str07(spark, d):
    raw = F.concat(F.lit(" "), F.replace("s_name", F.lit("#"), F.lit("+")), F.lit("@Example.COM "))
    return read(spark, d, "supplier").select("s_suppkey", text.normal_email(raw).alias("email"))


@plan("str08_noreply_logins", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'user' || s_suppkey END AS login FROM supplier
""")
def str08(spark, d):
    k = F.col("s_suppkey").cast("string")
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat(k, F.lit("+User"), k, F.lit("@users.noreply.github.com"))).otherwise(
        F.concat(F.lit("user"), k, F.lit("@example.com"))
    )
    return read(spark, d, "supplier").select("s_suppkey", text.noreply_login(raw).alias("login"))


@plan("str09_reverts", """
    SELECT event_type, count(*) FILTER (WHERE event_id % 4 = 0) AS n FROM events GROUP BY event_type
""")
def str09(spark, d):
    msg = F.when(F.col("event_id") % 4 == 0, '  revert "Fix"').otherwise("Reverting the change")
    return read(spark, d, "events").groupBy("event_type").agg(F.count_if(text.is_revert(msg)).alias("n"))


@plan("str10_path_tokens", """
    WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS p FROM pages),
    s AS (SELECT page_id, p, list_filter(string_split(p, '/'), lambda x: true) AS parts FROM p WHERE p <> ''),
    t AS (
        SELECT page_id, 'path:' || p AS tok FROM s
        UNION ALL
        SELECT page_id, 'dir:' || array_to_string(parts[1:i], '/') FROM s, unnest(range(1, len(parts))) r(i)
    )
    SELECT page_id, string_agg(tok, ' ' ORDER BY tok) AS tokens FROM (SELECT DISTINCT page_id, tok FROM t) GROUP BY page_id
""")
def str10(spark, d):
    rows = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("p")).where("p <> ''")
    return rows.select("page_id", F.array_join(text.path_tokens(F.array("p")), " ").alias("tokens"))


@plan("str21_digits", "SELECT c_custkey, CAST(regexp_extract(c_name, '\\d+', 0) AS BIGINT) AS n FROM customer")
def str21(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.digits(F.col("c_name")).alias("n"))


@plan("str22_evidence_ids", """
    SELECT l_suppkey, l_partkey, 'EV-' || substr(sha256(concat_ws(':', l_suppkey, l_partkey, 'github')), 1, 8) AS evidence_id
    FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
""")
def str22(spark, d):
    rows = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    key = text.evidence_id(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.lit("github"))
    return rows.withColumn("evidence_id", key)


@plan("str24_content_hash", "SELECT page_id, sha256(coalesce(html, '')) AS content_hash FROM pages")
def str24(spark, d):
    return read(spark, d, "pages").select("page_id", text.content_hash(F.col("html")).alias("content_hash"))


@plan("str12_titles", "SELECT conv_id, turn, string_split(text, chr(10))[1] AS title FROM conversations")
def str12(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", text.first_line(F.col("text")).alias("title"))


@plan("dat01_parse_dates", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders
""")
def dat01(spark, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = (
        F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "yyyy/MM/dd"))
        .when(k == 2, F.date_format(t, "dd-MM-yyyy")).when(k == 3, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    )
    return read(spark, d, "orders").select("o_orderkey", dates.parse_date(raw).alias("day"))


@plan("dat06_months", """
    SELECT o_orderkey, round_even(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-11-05') / 30.44, 6) AS months,
        CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-11-05') / 30.44 <= 12 THEN 3
             WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-11-05') / 30.44 <= 24 THEN 2 ELSE 1 END AS age_cap FROM orders
""")
def dat06(spark, d):
    m = dates.months(F.col("o_orderdate").cast("date"), day(LINE_DAY))
    cap = dates.age_cap(F.col("o_orderdate").cast("date"), day(LINE_DAY))
    return read(spark, d, "orders").select("o_orderkey", F.bround(m, 6).alias("months"), cap.alias("age_cap"))


@plan("mth03_overlap", f"""
    WITH b AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark),
    p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t)) AS i, least(len(a.t), len(b.t)) AS s,
                 len(list_distinct(list_concat(a.t, b.t))) AS u FROM b a JOIN b b ON b.item_id = a.item_id + 1)
    SELECT a, b, round_even(CASE WHEN s > 0 THEN i / s ELSE 0 END, 6) AS overlap,
           round_even(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS jaccard FROM p
""")
def mth03(spark, d):
    b = read(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("t"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return b.join(other, "item_id").select(
        F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"),
        F.bround(measures.overlap(F.col("t"), F.col("u")), 6).alias("overlap"),
        F.bround(measures.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"),
    )


@plan("mth04_relevance", """
    WITH p AS (SELECT event_id, event_id % 2 = 0 AS s, (event_id % 100) / 100.0 AS o FROM events)
    SELECT event_id, round_even(CASE WHEN s THEN least(1.0, 0.75 + 0.25 * o) WHEN o >= 0.12 THEN least(0.6, 1.2 * o) ELSE 0 END::DOUBLE, 4) AS relevance,
        CASE WHEN s AND o > 0 THEN 'structural+textual' WHEN s THEN 'structural' WHEN o >= 0.12 THEN 'textual_only' ELSE 'none' END AS match_type FROM p
""")
def mth04(spark, d):
    s, o = F.col("event_id") % 2 == 0, (F.col("event_id") % 100) / 100.0
    return read(spark, d, "events").select(
        "event_id", measures.relevance(s, o).alias("relevance"), measures.match_type(s, o).alias("match_type")
    )


@plan("mth08_cosine", """
    SELECT a.vec_id AS a, b.vec_id AS b, round_even(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def mth08(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select(
        F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"),
        F.bround(measures.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"),
    )


@plan("mth13_weaker_certainty", """
    SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'tentative' WHEN l_returnflag = 'N' OR l_linestatus = 'F' THEN 'probable'
           ELSE 'certain' END AS weaker, count(*) AS n FROM lineitem GROUP BY 1, 2, 3
""")
def mth13(spark, d):
    a = F.when(F.col("l_returnflag") == "A", "certain").when(F.col("l_returnflag") == "N", "probable").otherwise("tentative")
    b = F.when(F.col("l_linestatus") == "F", "probable").otherwise("certain")
    return read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", measures.weaker_certainty(a, b).alias("weaker")).agg(F.count("*").alias("n"))


def _raw(spark, d):
    """The test tables in the shapes of raw telemetry."""
    e = read(spark, d, "events").withColumn("who", F.when(F.col("event_id") % 10 == 9, " ").otherwise(F.concat(F.lit("U"), F.col("user_id"))))
    rid, at = F.col("event_id").cast("string"), F.col("ts").cast("string")
    o = read(spark, d, "orders").withColumn("rid", F.col("o_orderkey").cast("string"))
    return {
        "commits": e.select(rid.alias("commit_id"), F.col("who").alias("author_id"), at.alias("timestamp"), F.col("event_type").alias("message"), F.array(F.col("event_type")).alias("files_changed"), F.lit("main").alias("branch")),
        "pull_requests": e.select(rid.alias("pr_id"), F.col("who").alias("author_id"), at.alias("timestamp"), F.col("event_type").alias("title"), F.col("props").alias("description"), F.when(F.col("event_type") == "purchase", "merged").otherwise("open").alias("status"), F.array(F.col("event_type")).alias("files"), F.lit("main").alias("target_branch")),
        "reviews": e.select(rid.alias("review_id"), F.col("who").alias("reviewer_id"), at.alias("timestamp"), F.col("event_type").alias("state"), F.array("props").alias("comments")),
        "issues": e.select(rid.alias("issue_id"), F.col("who").alias("author_id"), at.alias("timestamp"), F.col("event_type").alias("title"), F.col("props").alias("description"), F.lit("open").alias("status"), F.array("event_type").alias("labels")),
        "jira": e.select(rid.alias("jira_id"), F.when(F.col("event_id") % 3 == 0, F.col("who")).alias("assignee_id"), F.lit("lead").alias("reporter_id"), at.alias("timestamp"), F.col("event_type").alias("summary"), F.col("props").alias("description"), F.lit("open").alias("status"), F.array("event_type").alias("components")),
        "incidents": o.select(F.col("rid").alias("incident_id"), F.concat(F.lit("R"), F.col("o_custkey") % 5).alias("reporter_id"), F.concat(F.lit("R"), F.col("o_custkey") % 7).alias("lead_responder_id"), F.array(F.concat(F.lit("R"), F.col("o_custkey") % 5), F.concat(F.lit("R"), F.col("o_custkey") % 3), F.lit("")).alias("participants"), F.col("o_orderdate").cast("string").alias("timestamp"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("severity"), F.lit("svc").alias("service"), F.lit("s").alias("summary")),
        "deployments": e.select(rid.alias("deployment_id"), F.col("who").alias("deployed_by"), F.when(F.col("event_type") == "error", "rollback").otherwise("deploy").alias("action"), at.alias("timestamp"), F.lit("svc").alias("service"), F.lit("ok").alias("status"), F.col("props").alias("notes")),
        "documents": read(spark, d, "documents").select("doc_id", F.col("source").alias("author_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("last_modified_by"), F.lit("2024-01-01").alias("created_at"), F.lit(None).cast("string").alias("updated_at"), F.substring("text", 1, 20).alias("title"), F.lit("svc").alias("service"), F.col("text").alias("content_summary")),
    }


def _extractor(name, oracle):
    @plan(name, oracle)
    def run(spark, d):
        source = name.split("_", 1)[1]
        rows = events.EXTRACTORS[source](_raw(spark, d)[source])
        return rows.groupBy("employee_id", "action", "provenance_type").agg(F.count("*").alias("n"))

    return run


_WHO = "FROM events WHERE event_id % 10 <> 9 GROUP BY 1, 2, 3"
_extractor("prj01_commits", f"SELECT 'U' || user_id AS employee_id, 'commit_code' AS action, 'Demonstrated' AS provenance_type, count(*) AS n {_WHO}")
_extractor("prj02_pull_requests", f"""
    SELECT 'U' || user_id AS employee_id, CASE WHEN event_type = 'purchase' THEN 'merge_pull_request' ELSE 'create_pull_request' END AS action,
        CASE WHEN event_type = 'purchase' THEN 'Demonstrated' ELSE 'Proposed' END AS provenance_type, count(*) AS n {_WHO}
""")
_extractor("prj03_reviews", f"SELECT 'U' || user_id AS employee_id, 'review_pull_request' AS action, 'Review' AS provenance_type, count(*) AS n {_WHO}")
_extractor("prj04_issues", f"SELECT 'U' || user_id AS employee_id, 'create_issue' AS action, 'Proposed' AS provenance_type, count(*) AS n {_WHO}")
_extractor("prj05_jira", """
    SELECT CASE WHEN event_id % 3 = 0 AND event_id % 10 <> 9 THEN 'U' || user_id ELSE 'lead' END AS employee_id,
        'manage_jira_issue' AS action, 'Proposed' AS provenance_type, count(*) AS n FROM events GROUP BY 1, 2, 3
""")
_extractor("prj09_incidents", """
    WITH p AS (
        SELECT o_orderkey AS i, 'R' || (o_custkey % 7) AS who, 0 AS r FROM orders
        UNION ALL SELECT o_orderkey, 'R' || (o_custkey % 5), 1 FROM orders
        UNION ALL SELECT o_orderkey, 'R' || (o_custkey % 3), 1 FROM orders
    ), f AS (SELECT i, who, min(r) AS r FROM p GROUP BY i, who)
    SELECT who AS employee_id, CASE r WHEN 0 THEN 'lead_incident_response' ELSE 'participate_incident_response' END AS action,
        'Demonstrated' AS provenance_type, count(*) AS n FROM f GROUP BY 1, 2, 3
""")
_extractor("prj10_deployments", f"""
    SELECT 'U' || user_id AS employee_id, CASE WHEN event_type = 'error' THEN 'rollback_service' ELSE 'deploy_service' END AS action,
        'Demonstrated' AS provenance_type, count(*) AS n {_WHO}
""")
_extractor("prj11_documents", """
    SELECT CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS employee_id, 'write_documentation' AS action,
        'Demonstrated' AS provenance_type, count(*) AS n FROM documents GROUP BY 1, 2, 3
""")


@plan("set02_all_events", """
    SELECT s AS source_type, CASE s WHEN 'incident' THEN (
        SELECT count(*) FROM (SELECT DISTINCT o_orderkey, w FROM (SELECT o_orderkey, o_custkey % 7 AS w FROM orders UNION ALL
            SELECT o_orderkey, o_custkey % 5 FROM orders UNION ALL SELECT o_orderkey, o_custkey % 3 FROM orders)))
        WHEN 'jira_issue' THEN (SELECT count(*) FROM events) WHEN 'document' THEN (SELECT count(*) FROM documents)
        ELSE (SELECT count(*) FROM events WHERE event_id % 10 <> 9) END AS n
    FROM unnest(['commit', 'pull_request', 'review', 'issue', 'jira_issue', 'incident', 'deployment', 'document']) t(s)
""")
def set02(spark, d):
    return events.all_events(_raw(spark, d)).groupBy("source_type").agg(F.count("*").alias("n"))


@plan("joi06_evidence_records", """
    SELECT DISTINCT 'U' || user_id AS employee_id, p_brand AS capability_id, event_type AS module_id, 'github' AS source,
        CAST(event_id AS VARCHAR) AS source_ref, 1.0 AS score
    FROM events JOIN (SELECT DISTINCT p_brand FROM part) ON event_type <> 'error' OR p_brand = 'Brand#1' WHERE event_id % 10 <> 9
""")
def joi06(spark, d):
    commits = events.commits(_raw(spark, d)["commits"]).withColumn("module_id", F.col("context.files")[0])
    kinds = read(spark, d, "events").select(F.col("event_type").alias("module_id")).distinct()
    brands = read(spark, d, "part").agg(F.collect_set("p_brand").alias("all"))  # one row
    held = F.when(F.col("module_id") != "error", F.col("all")).otherwise(F.array().cast("array<string>"))
    modules = kinds.crossJoin(F.broadcast(brands)).select("module_id", held.alias("capability_ids"))
    out = events.evidence_records(commits, modules, fallback="Brand#1")
    return out.select("employee_id", "capability_id", "module_id", "source", "source_ref", "score")


@plan("joi04_path_modules", """
    WITH p(prefix, module_id, ord) AS (VALUES ('http://m', 'mobile', 0), ('http://', 'plain', 1), ('https://', 'secure', 2))
    SELECT page_id AS record_id, arg_min(module_id, ord) AS module_id FROM pages JOIN p ON starts_with(url, prefix) GROUP BY page_id
""")
def joi04(spark, d):
    prefixes = spark.createDataFrame([("http://m", "mobile", 0), ("http://", "plain", 1), ("https://", "secure", 2)], "prefix string, module_id string, ord int")
    return events.first_prefix(read(spark, d, "pages").select(F.col("page_id").alias("record_id"), F.col("url").alias("file")), prefixes)


@plan("flt01_eligibility", """
    SELECT CASE WHEN user_id % 13 = 0 THEN 'bot' WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'merge_commit'
        WHEN event_type = 'view' AND event_id % 4 = 1 THEN 'revert' WHEN event_type = 'view' AND event_id % 4 = 2 THEN 'generated_paths'
        WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'unresolved_ticket' WHEN event_type = 'click' AND event_id % 3 = 1 THEN 'non_work_resolution'
        WHEN event_type = 'error' THEN 'notified_only' WHEN event_type = 'signup' THEN 'merger_only' END AS reason, count(*) AS n
    FROM events GROUP BY 1
""")
def flt01(spark, d):
    e, kind, i = read(spark, d, "events"), F.col("event_type"), F.col("event_id")
    rows = e.select(
        F.when(kind == "view", "commit").when(kind == "click", "ticket").otherwise("incident").alias("record_kind"),
        F.when(kind == "error", "notified_only").when(kind == "signup", "merger_only").otherwise("author").alias("actor_role"),
        F.when(F.col("user_id") % 13 == 0, "Dependabot[bot]").otherwise("ann@x.org").alias("native_actor_id"),
        F.lit(False).alias("is_service_account"),
        F.when(i % 4 == 1, 'Revert "x"').otherwise("fix").alias("message"),
        F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 2, F.array(F.lit("dist/a.js"), F.lit("yarn.lock"))).otherwise(F.array(F.lit("src/a.py"))).alias("files"),
        F.when(i % 4 == 0, 2).otherwise(1).alias("n_parents"),
        F.when(i % 3 == 1, "Won't Do").when(i % 3 == 2, "Done").alias("resolution"),
    )
    return normalize.assess(rows).groupBy(F.col("exclusion_reason").alias("reason")).agg(F.count("*").alias("n"))


@plan("rol01_commit_roles", """
    WITH r AS (
        SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'merger_only' ELSE 'author' END AS role, 'u' || user_id || '@x.org' AS actor FROM events
        UNION ALL SELECT event_id, 'author', 'bo@x.org' FROM events WHERE event_id % 5 <> 0 AND event_id % 2 = 0
    ) SELECT role, actor, count(*) AS n FROM r GROUP BY 1, 2
""")
def rol01(spark, d):
    i = F.col("event_id")
    rows = read(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id"), F.lit("@x.org")).alias("author_email"), F.lit("login").alias("author_login"),
        F.when(i % 2 == 0, F.concat(F.lit("fix\n\nCo-authored-by: Bo <bo@x.org>\nco-authored-by: Me <U"), F.col("user_id"), F.lit("@x.org>"))).otherwise("fix").alias("message"),
        F.when(i % 5 == 0, 2).otherwise(1).alias("n_parents"),
    )
    return normalize.commit_roles(rows).groupBy("role", "actor").agg(F.count("*").alias("n"))


@plan("rol06_incident_roles", """
    WITH r AS (SELECT user_id % 7 AS actor, CAST(ts AS DATE) AS record_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 3
        WHEN 'click' THEN 4 WHEN 'view' THEN 5 ELSE 6 END AS rung FROM events),
    m AS (SELECT record_id, actor, min(rung) AS rung FROM r GROUP BY 1, 2)
    SELECT rung, CASE rung WHEN 1 THEN 'postmortem_author' WHEN 3 THEN 'resolver' WHEN 4 THEN 'ack_then_escalated_away'
        WHEN 5 THEN 'assigned_no_detail' ELSE 'notified_only' END AS role, count(*) AS n FROM m GROUP BY 1, 2
""")
def rol06(spark, d):
    kind = F.col("event_type")
    entry = F.when(kind == "signup", "postmortem").when(kind == "purchase", "resolve_log_entry").when(kind == "click", "acknowledge_log_entry").when(kind == "view", "assign_log_entry").otherwise("trigger_log_entry")
    log = read(spark, d, "events").select(
        F.col("ts").cast("date").alias("record_id"), entry.alias("entry_type"), (F.col("user_id") % 7).alias("agent"),
        F.lit(None).cast("bigint").alias("assignee"), F.col("event_id").alias("ord"),
    )
    return normalize.incident_roles(log).groupBy("rung", "role").agg(F.count("*").alias("n"))


@plan("prj21_ticket_ladder", """
    SELECT CASE WHEN event_id % 4 < 2 THEN 'certain' WHEN event_id % 4 = 2 THEN 'probable' ELSE 'tentative' END AS certainty,
        CASE event_id % 4 WHEN 0 THEN 'component:' || event_type WHEN 1 THEN 'label:' || event_type WHEN 2 THEN 'project:PAY' ELSE 'unclassified' END AS tokens,
        count(*) AS n FROM events GROUP BY 1, 2
""")
def prj21(spark, d):
    i, kind = F.col("event_id") % 4, F.col("event_type")
    t = normalize.ticket_tokens(F.when(i == 0, F.array(kind)), F.when(i == 1, F.array(kind)), F.when(i == 2, F.lit("PAY")))
    rows = read(spark, d, "events").select(t.alias("t"))
    return rows.groupBy(F.col("t.certainty").alias("certainty"), F.array_join("t.tokens", ",").alias("tokens")).agg(F.count("*").alias("n"))


@plan("joi07_identities", """
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'email' WHEN 2 THEN 'login' ELSE 'unmapped' END AS rung,
        CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey END AS employee_id FROM supplier
""")
def joi07(spark, d):
    k, s = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    actor = F.when(k == 0, F.concat(F.lit("id"), s)).when(k == 1, F.concat(F.lit("M"), s, F.lit("+work@X.org"))).when(k == 2, F.concat(F.lit("1+lo"), s, F.lit("@users.noreply.github.com"))).otherwise(F.concat(F.lit("who"), s))
    native = F.when(k == 0, F.concat(F.lit("id"), s)).when(k == 1, F.concat(F.lit("m"), s, F.lit("@x.org"))).when(k == 2, F.concat(F.lit("Lo"), s)).otherwise(F.concat(F.lit("other"), s))
    rows = read(spark, d, "supplier")
    found = normalize.resolve_identities(
        rows.select("s_suppkey", F.lit("github").alias("source"), actor.alias("actor")),
        rows.select(F.lit("github").alias("source"), native.alias("native_id"), F.col("s_suppkey").alias("employee_id")),
    )
    return found.select("s_suppkey", "rung", "employee_id")


@plan("src12_repositories", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN 'org/r' || s_suppkey END AS repo FROM supplier")
def src12(spark, d):
    s, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    url = F.when(k == 0, F.concat(F.lit("https://github.com/org/r"), s, F.lit(".git"))).when(k == 1, F.concat(F.lit("https://www.github.com/org/r"), s, F.lit("/"))).otherwise(F.concat(F.lit("https://example.org/org/r"), s))
    return read(spark, d, "supplier").select("s_suppkey", files.url_repository(url).alias("repo"))


@plan("src16_service_ids", "SELECT s_suppkey, 'P' || s_suppkey AS service_id FROM supplier")
def src16(spark, d):
    url = F.concat(F.lit("https://x.example.com/service-directory/P"), F.col("s_suppkey").cast("string"), F.lit("/activity"))
    return read(spark, d, "supplier").select("s_suppkey", files.service_id(url).alias("service_id"))


@plan("flt10_record_search", """
    SELECT event_id, event_type FROM events WHERE event_type ILIKE '%IEW%' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')
    ORDER BY ts DESC, event_id DESC LIMIT 50
""")
def flt10(spark, d):
    e = read(spark, d, "events")
    rows = e.select(F.col("event_id").alias("record_id"), F.col("user_id").alias("person"), F.col("event_type").alias("title"), F.col("ts").alias("occurred_at"))
    found = reporting.record_search(rows, "IEW", e.where("event_type = 'purchase'").select(F.col("user_id").alias("person")))
    return found.select(F.col("record_id").alias("event_id"), F.col("title").alias("event_type"))


@plan("dat02_event_recency", f"""
    SELECT event_id, round_even(exp(-0.35 * greatest(date_diff('day', CAST(ts AS DATE), DATE '{EVENT_DAY}'), 0) / 365.0), 6) AS recency FROM events
""")
def dat02_events(spark, d):
    return read(spark, d, "events").select("event_id", dates.recency(F.col("ts").cast("date"), day(EVENT_DAY)).alias("recency"))
