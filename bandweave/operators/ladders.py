"""Role ladders and rows of raw payloads: each payload gives the actors it credits, the strongest signal first.

Payloads are JSON; the schemas name only what the ladders read. Ladders are
column expressions that give an array of (actor, role, rung).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

_ROLE = "array<struct<actor:string,role:string,rung:int>>"
GITHUB = """
    number bigint, _pr_number bigint, state string, merged boolean, merged_at string, created_at string, submitted_at string,
    title string, body string, user struct<login:string>, author struct<login:string>, parents array<struct<sha:string>>,
    commit struct<message:string,author:struct<email:string,date:string>>, stats struct<total:double>,
    files array<struct<filename:string>>, _files array<struct<filename:string>>, _pr_files array<struct<filename:string>>,
    _commits array<struct<commit:struct<author:struct<email:string>>,author:struct<login:string>>>
"""
JIRA = """
    fields struct<assignee:struct<accountId:string>,reporter:struct<accountId:string>,resolution:string>,
    changelog struct<histories:array<struct<author:struct<accountId:string>,items:array<struct<field:string,`toString`:string>>>>>,
    comment struct<comments:array<struct<author:struct<accountId:string>,body:string>>>
"""
INCIDENT = """
    id string, service struct<id:string>, tickets array<string>, created_at string, resolved_at string, responder string,
    postmortem struct<author:struct<id:string>>,
    log_entries array<struct<type:string,agent:struct<id:string,type:string>,assignees:array<struct<id:string,type:string>>>>
"""
_SHAPE = "assignee string, reporter string, issuetype string, status string, summary string, description string"
TICKET = f"key string, id string, {_SHAPE}, fields struct<{_SHAPE}>, payload struct<key string, id string, {_SHAPE}, fields struct<{_SHAPE}>>"


def _clean(c: Column) -> Column:
    """Trimmed text, null where there is none."""
    return F.nullif(F.trim(c), F.lit(""))


def _none() -> Column:
    return F.array().cast(_ROLE)


def _names(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _roles(actors: Column, role: str, rung: int) -> Column:
    one = lambda a: F.struct(a.alias("actor"), F.lit(role).alias("role"), F.lit(rung).alias("rung"))
    return F.transform(actors, one).cast(_ROLE)


def _one(actor: Column) -> Column:
    return F.filter(F.array(actor), lambda a: a.isNotNull())


def commit_ladder(p: Column) -> Column:
    """A merge has a merger only; else its author, then each co-author as written who isn't the author's address."""
    mail, login = _clean(p["commit"]["author"]["email"]), _clean(p["author"]["login"])
    actor = F.coalesce(mail, login)
    others = F.filter(text_co_authors(p["commit"]["message"]), lambda a: (a != "") & ~F.coalesce(a == mail, F.lit(False)))
    authors = F.concat(_roles(_one(actor), "author", 1), _roles(others, "author", 1))
    return F.when(F.size(p["parents"]) >= 2, _roles(_one(actor), "merger_only", 5)).otherwise(authors)


def text_co_authors(message: Column) -> Column:
    from .normalize import co_authors

    return co_authors(message)


def pull_ladder(p: Column) -> Column:
    """Of a merged pull request the distinct authors of its commits; without any, who opened it."""
    wrote = F.transform(p["_commits"], lambda c: F.coalesce(_clean(c["commit"]["author"]["email"]), _clean(c["author"]["login"])))
    authors = F.array_distinct(F.filter(_names(wrote), lambda a: a.isNotNull()))
    merged = F.coalesce(p["merged"], F.lit(False)) | _clean(p["merged_at"]).isNotNull()
    found = F.when(F.size(authors) > 0, authors).otherwise(_one(_clean(p["user"]["login"])))
    return F.when(merged, _roles(found, "pr_author", 2)).otherwise(_none())


def review_ladder(p: Column) -> Column:
    """A review with a body is substantive, one without an approval."""
    who = _one(_clean(p["user"]["login"]))
    return F.when(_clean(p["body"]).isNotNull(), _roles(who, "reviewer_substantive", 3)).otherwise(_roles(who, "reviewer_approval", 4))


def ticket_ladder(p: Column) -> Column:
    """Who moved it both ways; the assignee; who commented; the reporter: each person once, by the first that holds."""
    histories = p["changelog"]["histories"]

    def moved(*to: str) -> Column:
        hit = lambda i: (i["field"] == "status") & F.lower(F.trim(i["toString"])).isin(*to)
        mine = F.filter(histories, lambda h: F.exists(h["items"], hit))
        return _names(F.filter(F.transform(mine, lambda h: _clean(h["author"]["accountId"])), lambda a: a.isNotNull()))

    both = F.array_sort(F.array_intersect(moved("in progress"), moved("done", "closed", "resolved")))
    assignee = F.array_except(_one(_clean(p["fields"]["assignee"]["accountId"])), both)
    resolved = _clean(p["fields"]["resolution"]).isNotNull()
    seen = F.concat(both, assignee)
    said = F.filter(p["comment"]["comments"], lambda c: _clean(c["body"]).isNotNull())
    said = F.filter(_names(F.transform(said, lambda c: _clean(c["author"]["accountId"]))), lambda a: a.isNotNull())
    comments = F.array_except(said, seen)
    reporter = F.array_except(_one(_clean(p["fields"]["reporter"]["accountId"])), F.concat(seen, comments))
    return F.concat(
        _roles(both, "transition_actor", 1),
        F.when(resolved, _roles(assignee, "assignee_at_resolution", 2)).otherwise(_roles(assignee, "assignee_only", 4)),
        _roles(comments, "commenter_substantive", 3),
        _roles(reporter, "reporter_only", 5),
    )


def incident_ladder(p: Column) -> Column:
    """Postmortem author, escalation targets, resolvers, acknowledgers (escalating counts), the merely notified; users only.

    Without a log the responder stands for all but the postmortem.
    """
    log, wrote = p["log_entries"], _one(_clean(p["postmortem"]["author"]["id"]))
    user = lambda u: F.when(u["type"] == "user_reference", _clean(u["id"]))

    def agents(*kinds: str) -> Column:
        hit = lambda e: F.array_contains(F.array(*(F.trim(e["type"]).startswith(k) for k in kinds)), F.lit(True))
        found = F.transform(F.filter(log, hit), lambda e: user(e["agent"]))
        return F.array_sort(F.array_distinct(F.filter(_names(found), lambda a: a.isNotNull())))

    escalated = F.filter(log, lambda e: F.trim(e["type"]).startswith("escalate"))
    targets = F.flatten(F.transform(escalated, lambda e: F.transform(F.coalesce(e["assignees"], F.array().cast("array<struct<id:string,type:string>>")), user)))
    targets = F.array_sort(F.array_distinct(F.filter(_names(targets), lambda a: a.isNotNull())))
    out, seen = _roles(wrote, "postmortem_author", 1), wrote
    steps = (
        (targets, "escalation_target", 2), (agents("resolve"), "resolver", 3),
        (agents("acknowledge", "escalate"), "ack_then_escalated_away", 4), (agents("trigger"), "notified_only", 6),
    )
    for actors, role, rung in steps:
        new = F.array_except(actors, seen)
        out, seen = F.concat(out, _roles(new, role, rung)), F.concat(seen, new)
    responder = F.array_except(_one(_clean(p["responder"])), wrote)
    bare = F.concat(_roles(wrote, "postmortem_author", 1), _roles(responder, "assigned_no_detail", 5))
    return F.when(F.coalesce(F.size(log), F.lit(0)) > 0, out).otherwise(bare)


def _paths(files: Column) -> Column:
    return text.path_tokens(_names(F.transform(files, lambda f: f["filename"])))


def _exploded(
    rows: DataFrame, roles: Column, kind: Column, at: Column, tokens: Column, effort: Column, refs: Column, note: Column, more: dict[str, Column] | None = None
) -> DataFrame:
    """A row for each role. Filters see what the roles gave alone, so that none is moved before the payload is read and reads it again."""
    return rows.withColumn("_r", F.explode_outer(roles)).where("_r IS NOT NULL").select(
        "record_id", kind.alias("record_kind"), "_r.actor", "_r.role", "_r.rung", at.alias("occurred_at"), tokens.alias("tokens"),
        effort.alias("effort"), refs.alias("refs"), note.alias("note"), *(c.alias(name) for name, c in (more or {}).items()),
    )


def github_rows(records: DataFrame, missing: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """A row for each actor of a record (record_id, payload): reviews, pull requests and commits, told by their shape in one pass.

    Commits have the lines changed as effort, 0 without; the others none. Times
    that can't be read are missing, or null. more are further columns of the payload p.
    """
    p = F.col("p")
    read = records.select("record_id", F.from_json("payload", GITHUB).alias("p"))
    review = p["_pr_number"].isNotNull() | F.coalesce(p["state"].isin("APPROVED", "COMMENTED", "CHANGES_REQUESTED"), F.lit(False))
    pull = ~review & p["number"].isNotNull() & p["commit"].isNull()
    of = lambda reviews, pulls, commits: F.when(review, reviews).when(pull, pulls).otherwise(commits)
    message, title = F.coalesce(p["commit"]["message"], F.lit("")), F.coalesce(p["title"], F.lit(""))
    said = of(F.lit(""), F.concat(title, F.lit("\n"), F.coalesce(p["body"], F.lit(""))), message)
    about = F.concat(F.lit("review on PR #"), F.coalesce(p["_pr_number"].cast("string"), F.lit("None")))
    return _exploded(
        read, of(review_ladder(p), pull_ladder(p), commit_ladder(p)), F.when(review, "pr_review").otherwise("commit"),
        dates.parse_timestamp(of(p["submitted_at"], p["created_at"], p["commit"]["author"]["date"]), missing),
        _paths(of(p["_pr_files"], p["_files"], p["files"])), F.when(~review & ~pull, F.coalesce(p["stats"]["total"], F.lit(0.0))),
        F.array_sort(F.array_distinct(text.ticket_keys(said, ("PAY", "JIRA")))),
        of(about, F.substring(title, 1, 120), F.substring(text.first_line(message), 1, 120)), more,
    )


def incident_rows(records: DataFrame, missing: Column | None = None) -> DataFrame:
    """A row for each actor of an incident, with its service and tickets as tokens; as old as its resolution, else its creation."""
    p = F.col("p")
    read = records.select("record_id", F.from_json("payload", INCIDENT).alias("p"))
    service = F.transform(_one(_clean(p["service"]["id"])), lambda s: F.concat(F.lit("service:"), s))
    tickets = F.transform(_names(p["tickets"]), lambda t: F.concat(F.lit("ticket:"), t))
    at = dates.parse_timestamp(F.coalesce(_clean(p["resolved_at"]), p["created_at"]), missing)
    return _exploded(read, incident_ladder(p), F.lit("incident"), at, F.concat(service, tickets), F.lit(None).cast("double"), F.array().cast("array<string>"), F.lit(""))


def health(rows: DataFrame) -> DataFrame:
    """(actor, state, n): actors without an employee, the ones with eligible rows apart from the harmless."""
    state = F.when(F.count_if("eligible") > 0, "unmapped").otherwise("harmless")
    return rows.where("employee_id IS NULL").groupBy("actor").agg(state.alias("state"), F.count("*").alias("n"))


def _once(value: Column, use) -> Column:
    """use(value) with value computed once a row: an alias would be put in place of each of its uses."""
    return F.transform(F.array(value), use)[0]


def _object(value: Column, *names: str) -> Column:
    """Text fields of a JSON object, read once; text that is none is never parsed."""
    bare = F.ltrim(value, F.lit(" \t\r\n"))
    return F.from_json(F.when(bare.startswith("{"), bare), ", ".join(f"{n} string" for n in names))


def user_name(value: Column) -> Column:
    """A user given as text or as an object: display name, name, address, account, id; the first that isn't blank."""
    names = ("displayName", "name", "emailAddress", "accountId", "id")
    named = _once(_object(value, *names), lambda user: F.coalesce(*(_clean(user[n]) for n in names)))
    return F.coalesce(named, F.when(~F.coalesce(value, F.lit("")).startswith("{"), _clean(value)))


def ticket_fields(payload: Column) -> Column:
    """One shape for tickets that come flat, with fields, or wrapped in a payload; a payload is read once."""
    return _once(F.from_json(payload, TICKET), _ticket_fields)


def _ticket_fields(p: Column) -> Column:
    at = lambda *values: F.coalesce(*(_clean(v) for v in values))
    both = lambda name: (p[name], p["fields"][name], p["payload"][name], p["payload"]["fields"][name])
    who = lambda name: F.coalesce(*(user_name(v) for v in both(name)))
    named = lambda name: at(*(_object(v, "name")["name"] for v in both(name)), *both(name))
    said = at(*both("description"))
    assigned = F.coalesce(who("assignee"), _clean(F.regexp_extract(said, r"Assigned to ([^.\n]+)", 1)))
    return F.struct(
        at(p["key"], p["payload"]["key"], p["id"], p["payload"]["id"]).alias("id"), assigned.alias("assignee"), who("reporter").alias("reporter"),
        named("issuetype").alias("type"), named("status").alias("status"), at(*both("summary")).alias("summary"),
    )


def document_text(adf: Column) -> Column:
    """The text leaves of an Atlassian document, in order, joined by blanks."""
    leaves = F.regexp_extract_all(F.coalesce(adf, F.lit("")), F.lit(r'"text"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.array_join(F.transform(leaves, lambda t: F.replace(F.replace(t, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit(" "))), " ")
