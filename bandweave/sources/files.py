"""Readers with declared schemas; a missing source is an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

RAW = {
    "commits": "commit_id string, author_id string, timestamp string, message string, files_changed array<string>, lines_added int, lines_deleted int, branch string",
    "pull_requests": "pr_id string, author_id string, timestamp string, title string, description string, status string, files array<string>, target_branch string",
    "reviews": "review_id string, pr_id string, reviewer_id string, timestamp string, state string, comments array<string>",
    "issues": "issue_id string, author_id string, assignee_id string, timestamp string, title string, description string, status string, labels array<string>",
    "jira": "jira_id string, reporter_id string, assignee_id string, timestamp string, updated_at string, issue_type string, summary string, description string, status string, components array<string>",
    "incidents": "incident_id string, reporter_id string, lead_responder_id string, participants array<string>, timestamp string, resolved_at string, title string, severity string, service string, summary string, root_cause string, action_items array<string>",
    "deployments": "deployment_id string, deployed_by string, timestamp string, environment string, service string, action string, commit_hash string, status string, notes string",
    "documents": "doc_id string, author_id string, last_modified_by string, created_at string, updated_at string, doc_type string, title string, service string, content_summary string, filepath string",
}


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON array files; none if there is no such file or it is empty."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)


def read_payloads(spark: SparkSession, path: str, id_path: str) -> DataFrame:
    """(native_id, payload): each element of JSON array files as JSON without blanks, and its id; a missing file raises."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "array<string>")).alias("payload"))
    return rows.select(F.get_json_object("payload", id_path).alias("native_id"), "payload")


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    return read_payloads(spark, path, "$.key")


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    return read_payloads(spark, path, "$.id")


def _optional(spark: SparkSession, path: str, id_path: str) -> DataFrame:
    try:
        return read_payloads(spark, path, id_path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], "native_id string, payload string")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_code_host(spark: SparkSession, captured: str, generated: str) -> DataFrame:
    """(native_id, payload) of recorded commits, pull requests and reviews: those captured, or without any the generated.

    Ids are the commit's, pr-N and pr-N-review-ID. Of the three files the commits
    tell whether there is a capture; the others may be missing.
    """
    folder = captured if _exists(spark, f"{captured}/github_commits.json") else generated
    at = lambda name, key: _optional(spark, f"{folder}/github_{name}.json", key)
    pulls = at("pulls", "$.number").withColumn("native_id", F.concat(F.lit("pr-"), "native_id"))
    number = F.get_json_object("payload", "$._pr_number")
    reviews = at("reviews", "$.id").withColumn("native_id", F.concat(F.lit("pr-"), number, F.lit("-review-"), "native_id"))
    return at("commits", "$.sha").unionByName(pulls).unionByName(reviews)


TAXONOMY = {
    "capabilities": "id string, name string, description string",
    "modules": "id string, name string, service_id string, description string, capability_ids array<string>, jira_component string, path_prefixes array<string>",
    "services": "id string, name string, description string",
}


def read_taxonomy(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """capabilities, modules and services of three JSON files, any of which raises if it is missing; names default to ids, texts to empty ones."""
    out = {}
    for name, schema in TAXONOMY.items():
        rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{name}.json")
        rows = rows.withColumns({"name": F.coalesce("name", "id"), "description": F.coalesce("description", F.lit(""))})
        if name == "modules":
            rows = rows.withColumn("capability_ids", F.coalesce("capability_ids", F.array().cast("array<string>")))
        out[name] = rows
    return out


def component_slugs(spark: SparkSession, path: str, modules: DataFrame) -> DataFrame:
    """(module_id, slug): the component of an optional modules file where it names one, else the module's own name."""
    given = read_json_array(spark, path, TAXONOMY["modules"]).select(F.col("id").alias("module_id"), F.nullif("jira_component", F.lit("")).alias("_component"))
    named = modules.select(F.col("id").alias("module_id"), "name").join(given, "module_id", "left")
    return named.select("module_id", text.slug(F.coalesce("_component", "name")).alias("slug"))


def url_repository(url) -> Column:
    """owner/repo of a code host's address, null for other hosts."""
    host, path = F.parse_url(url, F.lit("HOST")), F.parse_url(url, F.lit("PATH"))
    name = F.regexp_extract(path, r"^/([^/]+/[^/]+?)(?:\.git)?/?$", 1)
    return F.when(host.isin("github.com", "www.github.com") & (name != ""), name)


def service_id(url) -> Column:
    return F.nullif(F.regexp_extract(url, "/(?:service-directory|services)/([A-Z0-9]+)", 1), F.lit(""))
