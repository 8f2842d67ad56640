"""Payloads to items: role ladders, eligibility, identities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOT_ACTORS, GENERATED_PATHS, NON_WORK_RESOLUTIONS
from ..functions import text


def glob_pattern(patterns: tuple[str, ...]) -> str:
    """One anchored, case-insensitive regular expression for shell patterns; brackets hold a set of characters."""
    out = []
    for p in patterns:
        body, i = "", 0
        while i < len(p):
            end = p.find("]", i + 1)
            if p[i] == "[" and end > i:
                body += "[" + re.sub(r"([\\\[\]^&])", r"\\\1", p[i + 1 : end]) + "]"
                i = end
            else:
                body += {"*": "(?s:.*)", "?": "(?s:.)"}.get(p[i], re.escape(p[i]))
            i += 1
        out.append(body)
    return rf"(?i)^(?:{'|'.join(out)})$"


def matches_any(value: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(value, F.lit("")).rlike(glob_pattern(patterns))


def exclusion_reason() -> Column:
    """The first rule that excludes a row, else null.

    Expects record_kind, actor_role, native_actor_id, is_service_account,
    message, files, n_parents, resolution.
    """
    kind, role, files = F.col("record_kind"), F.col("actor_role"), F.coalesce("files", F.array().cast("array<string>"))
    commit, ticket = kind == "commit", kind == "ticket"
    generated = (F.size(files) > 0) & F.forall(files, lambda f: matches_any(f, GENERATED_PATHS))
    return (
        F.when(F.coalesce("is_service_account", F.lit(False)) | matches_any(F.col("native_actor_id"), BOT_ACTORS), "bot")
        .when(commit & (F.col("n_parents") >= 2) & (F.size(files) == 0), "merge_commit")
        .when(commit & text.is_revert(F.coalesce("message", F.lit(""))), "revert")
        .when(commit & generated, "generated_paths")
        .when(ticket & (F.coalesce("resolution", F.lit("")) == ""), "unresolved_ticket")
        .when(ticket & F.col("resolution").isin(*NON_WORK_RESOLUTIONS), "non_work_resolution")
        .when(ticket & (role == "reporter_only"), "reporter_only")
        .when((kind == "incident") & (role == "notified_only"), "notified_only")
        .when(role == "merger_only", "merger_only")
    )


def assess(rows: DataFrame) -> DataFrame:
    reason = exclusion_reason()
    return rows.withColumn("exclusion_reason", reason).withColumn("eligible", F.col("exclusion_reason").isNull())


def co_authors(message: Column) -> Column:
    """Addresses of Co-authored-by lines, in order."""
    found = F.regexp_extract_all(
        F.coalesce(message, F.lit("")), F.lit(r"(?im)^Co-authored-by:[^<\n]*<([^>\n]+)>"), F.lit(1)
    )
    return F.transform(found, lambda a: F.trim(a))


def commit_roles(commits: DataFrame) -> DataFrame:
    """commits by (actor, role, rung): a merge has a merger only; else the author and the co-authors who aren't the author."""
    actor = F.coalesce(F.nullif(F.trim("author_email"), F.lit("")), F.col("author_login"))
    role = lambda who, name, rung: F.struct(who.alias("actor"), F.lit(name).alias("role"), F.lit(rung).alias("rung"))
    others = F.filter(F.array_distinct(co_authors(F.col("message"))), lambda a: F.lower(a) != F.lower(actor))
    written = F.concat(F.array(role(actor, "author", 1)), F.transform(others, lambda a: role(a, "author", 1)))
    merged = F.array(role(actor, "merger_only", 5))
    rows = commits.withColumn("_r", F.explode(F.when(F.col("n_parents") >= 2, merged).otherwise(written)))
    return rows.select("*", "_r.actor", "_r.role", "_r.rung").drop("_r").where("actor IS NOT NULL")


def review_role(body: Column) -> Column:
    return F.when(F.trim(F.coalesce(body, F.lit(""))) != "", "reviewer_substantive").otherwise("reviewer_approval")


def first_role(roles: DataFrame, record: str = "record_id", actor: str = "actor") -> DataFrame:
    """One role an actor of a record: the lowest rung, then the order of emission."""
    w = Window.partitionBy(record, actor).orderBy("rung", "ord")
    return roles.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def incident_roles(log: DataFrame) -> DataFrame:
    """(record_id, actor, role, rung) from log entries (record_id, entry_type, agent, assignee, ord)."""
    kind = F.col("entry_type")
    target = F.when(kind.startswith("escalate"), F.col("assignee")).otherwise(F.col("agent"))
    rung = (
        F.when(kind.startswith("postmortem"), 1).when(kind.startswith("escalate"), 2).when(kind.startswith("resolve"), 3)
        .when(kind.startswith("acknowledge"), 4).when(kind.startswith("assign"), 5).when(kind.startswith("trigger"), 6)
    )
    names = ("postmortem_author", "escalation_target", "resolver", "ack_then_escalated_away", "assigned_no_detail", "notified_only")
    rows = log.withColumn("actor", target).withColumn("rung", rung).where("rung IS NOT NULL AND actor IS NOT NULL")
    return first_role(rows.withColumn("role", F.element_at(F.array(*map(F.lit, names)), F.col("rung")))).select(
        "record_id", "actor", "role", "rung"
    )


def ticket_tokens(components: Column, labels: Column, project: Column) -> Column:
    """(tokens, certainty): components, else labels, else the project, else unclassified."""
    tag = lambda c, name: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.concat(F.lit(name), v))
    pack = lambda t, c: F.struct(F.array_sort(t).alias("tokens"), F.lit(c).alias("certainty"))
    return (
        F.when(F.size(F.coalesce(components, F.array().cast("array<string>"))) > 0, pack(tag(components, "component:"), "certain"))
        .when(F.size(F.coalesce(labels, F.array().cast("array<string>"))) > 0, pack(tag(labels, "label:"), "certain"))
        .when(F.coalesce(project, F.lit("")) != "", pack(F.array(F.concat(F.lit("project:"), project)), "probable"))
        .otherwise(pack(F.array(F.lit("unclassified")), "tentative"))
    )


def resolve_identities(items: DataFrame, identities: DataFrame) -> DataFrame:
    """Adds employee_id and rung: exact id, else normalised e-mail, else the login of a noreply address.

    items has source and actor; identities source, native_id, employee_id. Each
    rung is an equi-join; the strongest that resolves counts.
    """
    one = lambda key: identities.groupBy("source", key.alias("_key")).agg(F.min("employee_id").alias("_who"))
    out = items.withColumns({"_exact": F.col("actor"), "_mail": text.normal_email(F.col("actor")), "_login": text.noreply_login(F.col("actor"))})
    steps = (("exact", "_exact", F.col("native_id")), ("email", "_mail", text.normal_email(F.col("native_id"))), ("login", "_login", F.lower("native_id")))
    for name, column, key in steps:
        side = one(key).select(F.col("source").alias(f"_s{name}"), F.col("_key").alias(f"_k{name}"), F.col("_who").alias(f"_w{name}"))
        out = out.join(side, (F.col("source") == F.col(f"_s{name}")) & (F.col(column) == F.col(f"_k{name}")), "left").drop(f"_s{name}", f"_k{name}")
    rung = F.when(F.col("_wexact").isNotNull(), "exact").when(F.col("_wemail").isNotNull(), "email").when(F.col("_wlogin").isNotNull(), "login").otherwise("unmapped")
    out = out.withColumn("employee_id", F.coalesce("_wexact", "_wemail", "_wlogin")).withColumn("rung", rung)
    return out.drop("_exact", "_mail", "_login", "_wexact", "_wemail", "_wlogin")
