"""Raw telemetry to normalised events: one projection a source, unioned in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = (
    "title string, description string, status string, files array<string>, branch string, role string,"
    " severity string, service string, labels array<string>, components array<string>, state string"
)
_FIELDS = {c.split()[0]: c.split()[1] for c in CONTEXT.split(", ")}
#: Required in every event.
REQUIRED = ("employee_id", "source", "source_type", "source_record_id", "action", "provenance_type")


def given(column: str | Column) -> Column:
    """Trimmed text; null where there is none."""
    value = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def _event(df: DataFrame, employee: Column, source: str, kind: str, record: str, action, at, provenance, **context) -> DataFrame:
    filled = [
        (context[n] if n in context else F.lit(None)).cast(k.rstrip(",")).alias(n) for n, k in _FIELDS.items()
    ]
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        employee.alias("employee_id"), F.lit(source).alias("source"), F.lit(kind).alias("source_type"),
        F.col(record).cast("string").alias("source_record_id"), lit(action).alias("action"),
        at.cast("string").alias("timestamp"), lit(provenance).alias("provenance_type"), F.struct(*filled).alias("context"),
    ).where(F.col("employee_id").isNotNull() & given("source_record_id").isNotNull())


def commits(df: DataFrame) -> DataFrame:
    return _event(
        df, given("author_id"), "github", "commit", "commit_id", "commit_code", F.col("timestamp"), "Demonstrated",
        description=F.col("message"), files=F.col("files_changed"), branch=F.col("branch"),
    )


def pull_requests(df: DataFrame) -> DataFrame:
    merged = F.upper(F.coalesce("status", F.lit(""))) == "MERGED"
    return _event(
        df, given("author_id"), "github", "pull_request", "pr_id",
        F.when(merged, "merge_pull_request").otherwise("create_pull_request"), F.col("timestamp"),
        F.when(merged, "Demonstrated").otherwise("Proposed"), title=F.col("title"), description=F.col("description"),
        status=F.col("status"), files=F.col("files"), branch=F.col("target_branch"),
    )


def reviews(df: DataFrame) -> DataFrame:
    return _event(
        df, given("reviewer_id"), "github", "review", "review_id", "review_pull_request", F.col("timestamp"), "Review",
        state=F.col("state"), description=F.array_join("comments", " "),
    )


def issues(df: DataFrame) -> DataFrame:
    return _event(
        df, given("author_id"), "github", "issue", "issue_id", "create_issue", F.col("timestamp"), "Proposed",
        title=F.col("title"), description=F.col("description"), status=F.col("status"), labels=F.col("labels"),
    )


def jira(df: DataFrame) -> DataFrame:
    """The assignee, or else the reporter."""
    return _event(
        df, F.coalesce(given("assignee_id"), given("reporter_id")), "jira", "jira_issue", "jira_id",
        "manage_jira_issue", F.col("timestamp"), "Proposed", title=F.col("summary"), description=F.col("description"),
        status=F.col("status"), components=F.col("components"),
    )


def incidents(df: DataFrame) -> DataFrame:
    """An event for each person of an incident: lead, then participants, then the reporter; a person's first role counts."""
    person = lambda who, rank, role, action, provenance: F.struct(
        given(who).alias("who"), F.lit(rank).alias("rank"), F.lit(role).alias("role"),
        F.lit(action).alias("action"), F.lit(provenance).alias("provenance"),
    )
    taking_part = F.transform(
        F.coalesce("participants", F.array().cast("array<string>")),
        lambda p: person(p, 1, "participant", "participate_incident_response", "Demonstrated"),
    )
    all_of = F.concat(
        F.array(person("lead_responder_id", 0, "lead_responder", "lead_incident_response", "Demonstrated")),
        taking_part,
        F.array(person("reporter_id", 2, "reporter", "report_incident", "Observed")),
    )
    rows = df.select("*", F.explode(all_of).alias("p")).where("p.who IS NOT NULL")
    first = Window.partitionBy("incident_id", "p.who").orderBy("p.rank")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return _event(
        rows, F.col("p.who"), "incidents", "incident", "incident_id", F.col("p.action"), F.col("timestamp"),
        F.col("p.provenance"), role=F.col("p.role"), title=F.col("title"), description=F.col("summary"),
        severity=F.col("severity"), service=F.col("service"),
    )


def deployments(df: DataFrame) -> DataFrame:
    back = F.upper(F.coalesce("action", F.lit(""))) == "ROLLBACK"
    return _event(
        df, given("deployed_by"), "deployments", "deployment", "deployment_id",
        F.when(back, "rollback_service").otherwise("deploy_service"), F.col("timestamp"), "Demonstrated",
        description=F.col("notes"), status=F.col("status"), service=F.col("service"),
    )


def documents(df: DataFrame) -> DataFrame:
    return _event(
        df, F.coalesce(given("last_modified_by"), given("author_id")), "documentation", "document", "doc_id",
        "write_documentation", F.coalesce("updated_at", "created_at"), "Demonstrated",
        title=F.col("title"), description=F.col("content_summary"), service=F.col("service"),
    )


EXTRACTORS = {
    "commits": commits, "pull_requests": pull_requests, "reviews": reviews, "issues": issues, "jira": jira,
    "incidents": incidents, "deployments": deployments, "documents": documents,
}


def all_events(sources: dict[str, DataFrame]) -> DataFrame:
    """Events of all given sources, those without a required value left out."""
    parts = [EXTRACTORS[name](sources[name]) for name in EXTRACTORS if name in sources]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in REQUIRED)))


def weight(provenance: Column) -> Column:
    return F.when(provenance == "Demonstrated", 1.0).otherwise(0.5)


def first_prefix(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(record_id, module_id): the first prefix, in the order given, of each file; joined on the prefix's length and text.

    files has record_id and file; prefixes, a small dimension, prefix, module_id and ord.
    """
    sizes = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())
    cut = files.withColumn("prefix", F.explode(F.array(*(F.substring("file", 1, n) for n in sizes))))
    hit = cut.join(prefixes, "prefix").groupBy("record_id", "file").agg(F.min(F.struct("ord", "module_id")).alias("m"))
    return hit.select("record_id", "m.module_id").distinct()


def evidence_records(events: DataFrame, modules: DataFrame, known: DataFrame | None = None, fallback: str | None = None) -> DataFrame:
    """(evidence_id, employee_id, capability_id, module_id, source, source_ref, score): events by module by capability.

    events has module_id; modules module_id and capability_ids; a module without
    any stands for the fallback, if one is given. Records are distinct by their
    five keys; those already known are left out.
    """
    from ..functions import text

    keys = ["employee_id", "capability_id", "module_id", "source", "source_ref"]
    ids = F.col("capability_ids")
    ids = F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit(fallback))) if fallback else ids
    once = events.select(
        "employee_id", "module_id", "source", F.col("source_record_id").alias("source_ref"), weight(F.col("provenance_type")).alias("score"), "timestamp",
    ).dropDuplicates([k for k in keys if k != "capability_id"])  # before the capabilities multiply the rows
    rows = once.join(modules.select("module_id", F.explode(ids).alias("capability_id")).distinct(), "module_id")
    rows = rows.select("employee_id", "capability_id", "module_id", "source", "source_ref", "score", "timestamp")
    if known is not None:
        rows = rows.join(known.select(*keys), keys, "left_anti")
    return rows.withColumn("evidence_id", text.evidence_id(*(F.col(k) for k in keys)))
