"""The normalisation of raw records: rows of actors with identity and eligibility, inserted once; bad records beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..sources import datasets
from ..storage import forget, stored
from . import ladders, normalize

SCHEMAS = {"github": ladders.GITHUB, "jira": ladders.JIRA, "incident": ladders.INCIDENT}
REASONS = (
    "bot", "merge_commit", "revert", "generated_paths", "unresolved_ticket", "non_work_resolution", "reporter_only", "notified_only",
    "merger_only",
)
RUNGS = ("exact", "email", "login", "unmapped")
KEY = ["record_id", "actor"]


def bad_payload(source: Column, payload: Column) -> Column:
    """Why a payload can't be read, null if it can: no JSON object, or a field of another shape than the source has."""
    text = F.trim(F.coalesce(payload, F.lit("")))
    fault = F.when(text == "", "empty payload").when(F.try_parse_json(text).isNull(), "not JSON").when(~text.startswith("{"), "not an object")
    for kind, schema in SCHEMAS.items():
        read = F.from_json(text, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        fault = F.coalesce(fault, F.when((source == kind) & read["_bad"].isNotNull(), "a field of another shape"))
    return fault


def _no_commit() -> tuple[Column, Column, Column]:
    """Message, files and number of parents of what is no commit."""
    return F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(0)


def _ticket_rows(records: DataFrame, missing: Column | None) -> DataFrame:
    """A row for each actor of a ticket; tokens from components, else labels, else the project."""
    p = F.from_json("payload", ladders.JIRA)
    names = lambda path: F.from_json(F.get_json_object("payload", path), "array<string>")
    parts = F.transform(F.from_json(F.get_json_object("payload", "$.fields.components"), "array<struct<name: string>>"), lambda c: c["name"])
    tokens = normalize.ticket_tokens(parts, names("$.fields.labels"), F.get_json_object("payload", "$.fields.project.key"))
    at = dates.parse_timestamp(F.coalesce(F.get_json_object("payload", "$.fields.updated"), F.get_json_object("payload", "$.fields.created")), missing)
    resolution = F.coalesce(F.get_json_object("payload", "$.fields.resolution.name"), F.get_json_object("payload", "$.fields.resolution"))
    rows = records.withColumn("_r", F.explode(ladders.ticket_ladder(p)))
    return rows.select(
        "record_id", F.lit("ticket").alias("record_kind"), "_r.actor", "_r.role", "_r.rung", at.alias("occurred_at"),
        tokens["tokens"].alias("tokens"), F.lit(None).cast("double").alias("effort"), F.array().cast("array<string>").alias("refs"),
        F.substring(F.coalesce(F.get_json_object("payload", "$.fields.summary"), F.lit("")), 1, 120).alias("note"),
        *(c.alias(name) for name, c in _facts(*_no_commit(), resolution).items()),
    )


def _facts(message: Column, files: Column, n_parents: Column, resolution: Column) -> dict[str, Column]:
    """What eligibility looks at besides the row."""
    return {"message": message, "files": files, "n_parents": n_parents, "resolution": resolution}


def _marked(records: DataFrame) -> DataFrame:
    """(record_id, source, native_id, payload, error) of the sources of SCHEMAS, written once, since rows and errors are read from it."""
    known = records.where(F.col("source").isin(*SCHEMAS)).withColumn("error", bad_payload(F.col("source"), F.col("payload")))
    return stored(known.select("record_id", "source", "native_id", "payload", "error"), "marked")


def normalised(records: DataFrame, identities: DataFrame, bots: DataFrame, missing: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of records (record_id, source, native_id, payload).

    rows: one for each record and actor, the first of the ladder's order, with
    employee_id and rung of identity, eligible and exclusion_reason. errors:
    (record_id, source, native_id, error) of records that can't be read; the
    others go on. Records of other sources than SCHEMAS are left out. bots has
    employee_id of service accounts.
    """
    return _from_marked(_marked(records), identities, bots, missing)


def _from_marked(known: DataFrame, identities: DataFrame, bots: DataFrame, missing: Column | None) -> tuple[DataFrame, DataFrame]:
    errors = known.where("error IS NOT NULL").select("record_id", "source", "native_id", "error")
    good = known.where("error IS NULL")
    of = lambda kind: good.where(F.col("source") == kind).select("record_id", "payload")
    g, none = F.col("p"), F.lit(None).cast("string")
    files = F.transform(F.coalesce(g["files"], g["_files"], g["_pr_files"]), lambda f: f["filename"])
    facts = _facts(g["commit"]["message"], files, F.coalesce(F.size(g["parents"]), F.lit(0)), none)
    parts = {
        "github": ladders.github_rows(of("github"), missing, facts),
        "incident": ladders.incident_rows(of("incident"), missing).withColumns(_facts(*_no_commit(), none)),
        "jira": _ticket_rows(of("jira"), missing),
    }
    rows = reduce(DataFrame.unionByName, (df.withColumn("source", F.lit(source)) for source, df in parts.items()))
    first = Window.partitionBy(*KEY).orderBy("rung", "role", F.col("effort").desc_nulls_last())
    rows = rows.where("actor IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    rows = rows.withColumnRenamed("rung", "role_rung")
    rows = normalize.resolve_identities(rows, identities).join(bots.select("employee_id", F.lit(True).alias("_bot")).distinct(), "employee_id", "left")
    rows = rows.withColumns({"actor_role": F.col("role"), "native_actor_id": F.col("actor"), "is_service_account": F.coalesce("_bot", F.lit(False))})
    return normalize.assess(rows).select(
        "record_id", "source", "record_kind", "actor", "role", "employee_id", "rung", "occurred_at", "tokens", "effort", "eligible", "exclusion_reason"
    ), errors


def _counters() -> list[Column]:
    hit = lambda c, name: F.count_if(c).alias(name)
    unmapped = F.col("employee_id").isNull()
    return [
        F.count(F.lit(1)).alias("rows"), hit(F.col("_new"), "inserted"), hit(~F.col("_new"), "skipped"), hit(F.col("eligible"), "eligible"),
        hit(unmapped & F.col("eligible"), "unmapped"), hit(unmapped & ~F.col("eligible"), "unmapped_harmless"),
        *(hit(F.col("exclusion_reason") == r, f"excluded_{r}") for r in REASONS), *(hit(F.col("rung") == r, f"identity_{r}") for r in RUNGS),
    ]


def normalise_into(records: DataFrame, identities: DataFrame, bots: DataFrame, path: str, missing: Column | None = None) -> dict[str, int]:
    """Insert the rows of records that the dataset at path/items doesn't hold, put the bad records to path/errors, and return counters.

    A row is known by record and actor, so a second run inserts nothing. Counters
    are taken in the pass that writes.
    """
    spark = records.sparkSession
    marked_records = _marked(records)
    rows, errors = _from_marked(marked_records, identities, bots, missing)
    old = datasets.read(spark, f"{path}/items")
    if old is None:
        marked = rows.withColumn("_new", F.lit(True))
    else:
        marked = rows.join(old.select(*KEY, F.lit(False).alias("_old")), KEY, "left").withColumn("_new", F.col("_old").isNull()).drop("_old")
    seen = Observation()
    made = stored(marked.observe(seen, *_counters()).where("_new").drop("_new"), "normalised")
    counted = dict(seen.get)
    datasets.replace(made if old is None else old.unionByName(made), f"{path}/items")
    counted["errors"] = datasets.replace(errors, f"{path}/errors")
    forget(made, marked_records)
    return counted
