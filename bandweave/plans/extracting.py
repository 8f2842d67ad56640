"""Plans of role ladders and payload rows. Payloads are built from events, ten to a record; the SQL works on the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ladders
from .registry import plan, read

_E = "e AS (SELECT event_id // 10 AS rec, event_id % 10 AS k, 'u' || (user_id % 7) AS u, user_id, event_type AS t, value AS v FROM events)"
_OUT = "SELECT record_id, actor, role, rung FROM"


def _events(spark, d):
    return read(spark, d, "events").select(
        F.floor(F.col("event_id") / 10).alias("record_id"), (F.col("event_id") % 10).alias("k"), F.concat(F.lit("u"), F.col("user_id") % 7).alias("u"),
        "user_id", F.col("event_type").alias("t"), F.col("value").alias("v"),
    )


def _listed(struct, keep=None):
    """Values of a record's events in their order."""
    one = F.struct("k", struct.alias("x"))
    return F.transform(F.array_sort(F.collect_list(F.when(keep, one) if keep is not None else one)), lambda o: o["x"])


def _payloads(rows, **fields):
    return rows.groupBy("record_id").agg(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("payload"))


def _roles(payloads, schema, ladder):
    found = payloads.select("record_id", F.explode(ladder(F.from_json("payload", schema))).alias("r"))
    return found.select("record_id", "r.actor", "r.role", "r.rung")


def _pulls(spark, d):
    e, five = _events(spark, d), (F.col("user_id") % 5).cast("string")
    mail, login = F.when(F.col("t") != "view", F.concat(F.lit("m"), five, F.lit("@x"))).otherwise(" "), F.when(F.col("t") != "error", F.concat(F.lit("l"), five))
    wrote = F.struct(F.struct(F.struct(mail.alias("email")).alias("author")).alias("commit"), F.struct(login.alias("login")).alias("author"))
    r = F.col("record_id")
    return _payloads(
        e, number=F.first(r), merged=F.first(r) % 3 == 0, merged_at=F.when(F.first(r) % 3 == 1, "2024-01-02T00:00:00Z"),
        user=F.struct(F.when(F.first(r) % 4 != 3, F.concat(F.lit("open"), F.first(r) % 4)).otherwise("  ").alias("login")),
        _commits=_listed(wrote, (F.col("record_id") % 5 > 0) & (F.col("k") < 4)), title=F.concat(F.lit("PAY-"), F.first(r).cast("string"), F.lit(" and JIRA-7")),
        created_at=F.lit("2024-01-01T10:00:00Z"), _files=F.array(F.struct(F.concat(F.lit("src/"), F.min("t"), F.lit(".py")).alias("filename"))),
    )


_PULLS = f"""{_E}, w AS (SELECT rec, coalesce(CASE WHEN t <> 'view' THEN 'm' || (user_id % 5) || '@x' END, CASE WHEN t <> 'error' THEN 'l' || (user_id % 5) END) AS a
        FROM e WHERE rec % 5 > 0 AND k < 4 AND rec % 3 < 2),
    n AS (SELECT DISTINCT rec FROM e WHERE rec % 3 < 2 AND rec NOT IN (SELECT rec FROM w WHERE a IS NOT NULL)),
    pu AS (SELECT DISTINCT rec AS record_id, a AS actor, 'pr_author' AS role, 2 AS rung FROM w WHERE a IS NOT NULL
        UNION ALL SELECT rec, 'open' || (rec % 4), 'pr_author', 2 FROM n WHERE rec % 4 <> 3)"""


@plan("rol03_pull_roles", f"WITH {_PULLS} {_OUT} pu")
def rol03(spark, d):
    return _roles(_pulls(spark, d), ladders.GITHUB, ladders.pull_ladder)


@plan("prj19_pull_rows", f"""
    WITH {_PULLS}, m AS (SELECT rec, min(t) AS t FROM e GROUP BY rec)
    SELECT record_id, 'commit' AS record_kind, actor, role, rung, TIMESTAMP '2024-01-01 10:00:00' AS occurred_at, 'dir:src,path:src/' || t || '.py' AS tokens,
        NULL::DOUBLE AS effort, 'JIRA-7,PAY-' || record_id AS refs, 'PAY-' || record_id || ' and JIRA-7' AS note FROM pu JOIN m ON rec = record_id
""")
def prj19(spark, d):
    return _shown(ladders.github_rows(_pulls(spark, d)))


def _shown(rows):
    return rows.withColumns({"tokens": F.array_join("tokens", ","), "refs": F.array_join("refs", ","), "occurred_at": F.col("occurred_at").cast("timestamp_ntz")})


def _commits(spark, d):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    rows = read(spark, d, "events").withColumn("record_id", i)
    mail = F.when(i % 3 > 0, F.concat(F.lit("U"), u, F.lit("@x.org"))).otherwise(" ")
    message = F.when(i % 2 == 0, F.concat(F.lit("PAY-"), i.cast("string"), F.lit(" fix\n\nCo-authored-by: Bo <bo@x.org>\nCo-authored-by: Me <U"), u, F.lit("@x.org>\nCO-AUTHORED-BY: Bo <bo@x.org>"))).otherwise("fix")
    one = F.struct(F.lit("s").alias("sha"))
    return rows.select("record_id", F.to_json(F.struct(
        F.struct(message.alias("message"), F.struct(mail.alias("email"), F.lit("2024-01-01T10:00:00Z").alias("date")).alias("author")).alias("commit"),
        F.struct(F.concat(F.lit("l"), u).alias("login")).alias("author"), F.when(i % 5 == 0, F.array(one, one)).otherwise(F.array(one)).alias("parents"),
        F.struct(F.when(i % 4 > 0, F.col("value")).alias("total")).alias("stats"), F.array(F.struct(F.concat(F.lit("a/"), F.col("event_type")).alias("filename"))).alias("files"),
    )).alias("payload"))


@plan("prj18_commit_rows", """
    WITH b AS (SELECT event_id AS rec, CASE WHEN event_id % 3 > 0 THEN 'U' || user_id || '@x.org' ELSE 'l' || user_id END AS a, user_id AS u, event_type AS t, value AS v FROM events),
    r AS (SELECT rec, a AS actor, CASE WHEN rec % 5 = 0 THEN 'merger_only' ELSE 'author' END AS role, CASE WHEN rec % 5 = 0 THEN 5 ELSE 1 END AS rung FROM b
        UNION ALL SELECT rec, 'bo@x.org', 'author', 1 FROM b, (VALUES (1), (2)) WHERE rec % 5 > 0 AND rec % 2 = 0
        UNION ALL SELECT rec, 'U' || u || '@x.org', 'author', 1 FROM b WHERE rec % 5 > 0 AND rec % 2 = 0 AND rec % 3 = 0)
    SELECT r.rec AS record_id, 'commit' AS record_kind, actor, role, rung, TIMESTAMP '2024-01-01 10:00:00' AS occurred_at, 'dir:a,path:a/' || t AS tokens,
        CASE WHEN r.rec % 4 > 0 THEN v ELSE 0 END AS effort, CASE WHEN r.rec % 2 = 0 THEN 'PAY-' || r.rec ELSE '' END AS refs,
        CASE WHEN r.rec % 2 = 0 THEN 'PAY-' || r.rec || ' fix' ELSE 'fix' END AS note FROM r JOIN b ON r.rec = b.rec
""")
def prj18(spark, d):
    return _shown(ladders.github_rows(_commits(spark, d)))


@plan("rol04_review_rows", """
    SELECT event_id AS record_id, 'pr_review' AS record_kind, 'l' || user_id AS actor, CASE WHEN event_id % 3 = 0 THEN 'reviewer_substantive' ELSE 'reviewer_approval' END AS role,
        CASE WHEN event_id % 3 = 0 THEN 3 ELSE 4 END AS rung, NULL::TIMESTAMP AS occurred_at, '' AS tokens, NULL::DOUBLE AS effort, '' AS refs,
        'review on PR #' || CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE 'None' END AS note FROM events WHERE user_id % 4 > 0
""")
def rol04(spark, d):
    i = F.col("event_id")
    login = F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("l"), F.col("user_id"))).otherwise(" ")
    body = F.when(i % 3 == 0, "looks good").when(i % 3 == 1, "  ")
    p = F.struct(F.when(i % 2 == 0, i).alias("_pr_number"), F.lit("APPROVED").alias("state"), body.alias("body"), F.struct(login.alias("login")).alias("user"))
    return _shown(ladders.github_rows(read(spark, d, "events").select(i.alias("record_id"), F.to_json(p).alias("payload"))))


@plan("rol05_ticket_roles", f"""
    WITH {_E}, r1 AS (SELECT rec, u FROM e GROUP BY 1, 2 HAVING bool_or(t = 'click') AND bool_or(t = 'purchase')),
    a AS (SELECT rec, 'u' || (min(user_id) % 7) AS u FROM e GROUP BY 1),
    r2 AS (SELECT rec, u FROM a WHERE rec % 4 > 0 EXCEPT SELECT rec, u FROM r1),
    r3 AS (SELECT DISTINCT rec, u FROM e WHERE t = 'view' AND v >= 2 EXCEPT (SELECT rec, u FROM r1 UNION SELECT rec, u FROM r2)),
    r5 AS (SELECT rec, 'u' || (max(user_id) % 7) AS u FROM e GROUP BY 1 EXCEPT (SELECT rec, u FROM r1 UNION SELECT rec, u FROM r2 UNION SELECT rec, u FROM r3))
    SELECT rec AS record_id, u AS actor, 'transition_actor' AS role, 1 AS rung FROM r1
    UNION ALL SELECT rec, u, CASE WHEN rec % 2 = 0 THEN 'assignee_at_resolution' ELSE 'assignee_only' END, CASE WHEN rec % 2 = 0 THEN 2 ELSE 4 END FROM r2
    UNION ALL SELECT rec, u, 'commenter_substantive', 3 FROM r3 UNION ALL SELECT rec, u, 'reporter_only', 5 FROM r5
""")
def rol05(spark, d):
    e, t, r = _events(spark, d), F.col("t"), F.first("record_id")
    to = F.when(t == "click", " In Progress").when(t == "purchase", F.when(F.col("k") < 5, "Done").otherwise("closed")).otherwise("Open")
    item = F.struct(F.when(t == "error", "priority").otherwise("status").alias("field"), to.alias("toString"))
    moved = F.struct(F.struct(F.col("u").alias("accountId")).alias("author"), F.array(item).alias("items"))
    said = F.struct(F.struct(F.col("u").alias("accountId")).alias("author"), F.when(F.col("v") >= 2, "words").otherwise(" ").alias("body"))
    who = lambda c: F.struct(F.concat(F.lit("u"), c % 7).alias("accountId"))
    payloads = _payloads(
        e, changelog=F.struct(_listed(moved).alias("histories")), comment=F.struct(_listed(said, t == "view").alias("comments")),
        fields=F.struct(F.when(r % 4 > 0, who(F.min("user_id"))).alias("assignee"), who(F.max("user_id")).alias("reporter"), F.when(r % 2 == 0, "Fixed").alias("resolution")),
    )
    return _roles(payloads, ladders.JIRA, ladders.ticket_ladder)


def _incidents(spark, d):
    e, t, r = _events(spark, d), F.col("t"), F.first("record_id")
    kind = F.when(t == "click", "escalate_log_entry").when(t == "purchase", "resolve_log_entry").when(t == "view", "acknowledge_log_entry").otherwise("trigger_log_entry")
    human = F.when(F.col("k") % 3 > 0, "user_reference").otherwise("monitor_reference")
    target = lambda n: F.struct(F.concat(F.lit("u"), (F.col("user_id") + n) % 7).alias("id"), F.lit("user_reference").alias("type"))
    entry = F.struct(kind.alias("type"), F.struct(F.col("u").alias("id"), human.alias("type")).alias("agent"), F.array(target(1), target(3)).alias("assignees"))
    return _payloads(
        e, postmortem=F.struct(F.struct(F.when(r % 3 == 0, F.concat(F.lit("u"), r % 7)).alias("id")).alias("author")), log_entries=_listed(entry, F.col("record_id") % 4 > 0),
        responder=F.concat(F.lit("u"), r % 5), service=F.struct(F.when(r % 2 == 0, F.concat(F.lit("S"), r % 9)).alias("id")), tickets=F.array(F.concat(F.lit("PAY-"), r.cast("string"))),
        created_at=F.lit("2024-01-01T00:00:00Z"), resolved_at=F.when(r % 3 > 0, "2024-02-01T00:00:00Z"),
    )


_INCIDENTS = f"""{_E}, p AS (SELECT DISTINCT rec, 'u' || (rec % 7) AS u FROM e WHERE rec % 3 = 0), l AS (SELECT * FROM e WHERE rec % 4 > 0), h AS (SELECT * FROM l WHERE k % 3 > 0),
    x2 AS (SELECT rec, 'u' || ((user_id + n) % 7) AS u FROM l, (VALUES (1), (3)) q(n) WHERE t = 'click' EXCEPT SELECT * FROM p),
    x3 AS (SELECT rec, u FROM h WHERE t = 'purchase' EXCEPT (SELECT * FROM p UNION SELECT * FROM x2)),
    x4 AS (SELECT rec, u FROM h WHERE t IN ('view', 'click') EXCEPT (SELECT * FROM p UNION SELECT * FROM x2 UNION SELECT * FROM x3)),
    x6 AS (SELECT rec, u FROM h WHERE t NOT IN ('view', 'click', 'purchase') EXCEPT (SELECT * FROM p UNION SELECT * FROM x2 UNION SELECT * FROM x3 UNION SELECT * FROM x4)),
    x5 AS (SELECT DISTINCT rec, 'u' || (rec % 5) AS u FROM e WHERE rec % 4 = 0 EXCEPT SELECT * FROM p),
    ro AS (SELECT rec AS record_id, u AS actor, 'postmortem_author' AS role, 1 AS rung FROM p UNION ALL SELECT *, 'escalation_target', 2 FROM x2
        UNION ALL SELECT *, 'resolver', 3 FROM x3 UNION ALL SELECT *, 'ack_then_escalated_away', 4 FROM x4 UNION ALL SELECT *, 'assigned_no_detail', 5 FROM x5
        UNION ALL SELECT *, 'notified_only', 6 FROM x6)"""


@plan("rol06_incident_ladder", f"WITH {_INCIDENTS} {_OUT} ro")
def rol06_ladder(spark, d):
    """Escalation credits all assignees, escalating counts as acknowledging, monitors are nobody, a postmortem needs no log."""
    return _roles(_incidents(spark, d), ladders.INCIDENT, ladders.incident_ladder)


@plan("prj22_incident_rows", f"""
    WITH {_INCIDENTS} SELECT record_id, 'incident' AS record_kind, actor, role, rung,
        CASE WHEN record_id % 3 > 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS occurred_at,
        concat_ws(',', CASE WHEN record_id % 2 = 0 THEN 'service:S' || (record_id % 9) END, 'ticket:PAY-' || record_id) AS tokens,
        NULL::DOUBLE AS effort, '' AS refs, '' AS note FROM ro
""")
def prj22(spark, d):
    return _shown(ladders.incident_rows(_incidents(spark, d)))


@plan("prj17_record_kinds", """
    SELECT record_kind, role, count(*) AS n FROM (
        SELECT 'commit' AS record_kind, CASE WHEN event_id % 5 = 0 THEN 'merger_only' ELSE 'author' END AS role FROM events WHERE event_id % 2 = 1
        UNION ALL SELECT 'pr_review', 'reviewer_approval' FROM events WHERE event_id % 4 = 0
        UNION ALL SELECT 'commit', 'pr_author' FROM events WHERE event_id % 4 = 2) GROUP BY 1, 2
""")
def prj17(spark, d):
    """Payloads of three shapes in one table, told apart by their keys."""
    i = F.col("event_id")
    rows = _commits(spark, d).where("record_id % 2 = 1")
    user = F.struct(F.lit("ann").alias("login")).alias("user")
    e = read(spark, d, "events")
    reviews = e.where(i % 4 == 0).select(i.alias("record_id"), F.to_json(F.struct(F.lit("COMMENTED").alias("state"), i.alias("number"), user)).alias("payload"))
    pulls = e.where(i % 4 == 2).select(i.alias("record_id"), F.to_json(F.struct(F.lit(True).alias("merged"), i.alias("number"), user)).alias("payload"))
    found = ladders.github_rows(rows.unionByName(reviews).unionByName(pulls))
    return found.groupBy("record_kind", "role").agg(F.count("*").alias("n"))


@plan("prj24_health_report", """
    SELECT 'u' || user_id AS actor, CASE WHEN bool_or(event_type <> 'view') THEN 'unmapped' ELSE 'harmless' END AS state, count(*) AS n
    FROM events WHERE user_id % 3 = 0 GROUP BY 1
""")
def prj24(spark, d):
    e = read(spark, d, "events")
    known = F.when(F.col("user_id") % 3 > 0, F.col("user_id"))
    return ladders.health(e.select(F.concat(F.lit("u"), F.col("user_id")).alias("actor"), known.alias("employee_id"), (F.col("event_type") != "view").alias("eligible")))


@plan("prj06_ticket_shapes", """
    SELECT event_id, 'PAY-' || event_id AS id, CASE WHEN event_id % 5 = 4 THEN 'Cy' WHEN event_id % 2 = 0 THEN 'Ann' ELSE 'bo@x.org' END AS assignee, 'rep' AS reporter,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Bug' END AS type, event_type AS status, 'sum' AS summary FROM events
""")
def prj06(spark, d):
    """Flat, nested and wrapped tickets; users as text or objects; an assignee named in the description alone."""
    i, t = F.col("event_id"), F.col("event_type")
    key = F.concat(F.lit("PAY-"), i.cast("string"))
    none = i % 5 == 4
    person = F.when(~none, F.when(i % 2 == 0, F.struct(F.lit("Ann").alias("displayName"), F.lit("a@x.org").alias("emailAddress"))).otherwise(F.struct(F.lit(" ").alias("displayName"), F.lit("bo@x.org").alias("emailAddress"))))
    text_ = F.when(none, "Work. Assigned to Cy. Soon").otherwise("Work")
    fields = F.struct(person.alias("assignee"), F.lit("rep").alias("reporter"), F.struct(F.lit("Bug").alias("name")).alias("issuetype"), F.struct(t.alias("name")).alias("status"), F.lit("sum").alias("summary"), text_.alias("description"))
    flat = F.to_json(F.struct(key.alias("key"), person.alias("assignee"), F.lit("rep").alias("reporter"), t.alias("status"), F.lit("sum").alias("summary"), text_.alias("description")))
    nested = F.to_json(F.struct(key.alias("key"), fields.alias("fields")))
    wrapped = F.to_json(F.struct(F.struct(key.alias("key"), fields.alias("fields")).alias("payload")))
    p = F.when(i % 3 == 0, flat).when(i % 3 == 1, nested).otherwise(wrapped)
    return read(spark, d, "events").select("event_id", ladders.ticket_fields(p).alias("f")).select("event_id", "f.*")


@plan("prj07_user_names", """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Ann' WHEN 1 THEN 'bo' WHEN 2 THEN 'c@x.org' WHEN 3 THEN 'plain' END AS name FROM events
""")
def prj07(spark, d):
    k = F.col("event_id") % 5
    value = F.when(k == 0, '{"displayName": "Ann", "name": "x"}').when(k == 1, '{"displayName": "", "name": " bo "}').when(k == 2, '{"emailAddress": "c@x.org"}').when(k == 3, " plain ")
    return read(spark, d, "events").select("event_id", ladders.user_name(value).alias("name"))


@plan("prj08_document_text", """SELECT event_id, 'Hello "' || event_type || '" and more' AS said FROM events""")
def prj08(spark, d):
    leaf = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    inner = F.struct(F.lit("paragraph").alias("type"), F.array(leaf(F.lit("Hello")), leaf(quoted)).alias("content"))
    outer = F.struct(F.lit("doc").alias("type"), F.array(inner, F.struct(F.lit("paragraph").alias("type"), F.array(leaf(F.lit("and more"))).alias("content"))).alias("content"))
    return read(spark, d, "events").select("event_id", ladders.document_text(F.to_json(outer)).alias("said"))
