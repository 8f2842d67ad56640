"""Records: validation, sets of modules, label rules, graph links, explanations, incident payloads of a paging service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Local parts of addresses that look like automation.
AUTOMATION_NAMES = ("noreply", "no-reply", "bot", "ci", "build", "deploy", "release", "automation", "jenkins", "actions", "svc", "service")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds is_duplicate: a key that an earlier row has, too; rows without a key are no duplicates."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("is_duplicate", F.col(key).isNotNull() & (F.row_number().over(w) > 1))


def validated(rows: DataFrame, known_types: tuple[str, ...]) -> DataFrame:
    """Adds warnings, in the order of the checks, and fatal: nothing can be said of a record without an employee.

    rows has id, employee_id, description, type, module_id, is_duplicate.
    """
    checks = (
        (_blank(F.col("id")), "missing_evidence_id"), (~_blank(F.col("id")) & F.col("is_duplicate"), "duplicate_evidence_id"),
        (_blank(F.col("employee_id")), "missing_employee_id"), (_blank(F.col("description")), "empty_description"),
        (~_blank(F.col("type")) & ~F.col("type").isin(*known_types), "unknown_evidence_type"), (_blank(F.col("module_id")), "missing_module_id"),
    )
    found = F.array_compact(F.array(*(F.when(c, name) for c, name in checks)))
    return rows.withColumn("warnings", found).withColumn("fatal", _blank(F.col("employee_id")))


def label_modules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(event_id, module_id) of labels, compared without case and outer blanks."""
    labels = events.select("event_id", F.explode("labels").alias("label")).select("event_id", F.lower(F.trim("label")).alias("label"))
    return labels.join(rules.select(F.lower(F.trim("label")).alias("label"), "module_id"), "label").select("event_id", "module_id").distinct()


def module_sets(by_file: DataFrame, by_label: DataFrame) -> DataFrame:
    """(event_id, module_id) that files or labels name."""
    return by_file.unionByName(by_label).distinct()


def label_rules(sources: dict[str, DataFrame]) -> DataFrame:
    """(label, module_id, origin): of rules for one label that of the last source holds; sources by rising precedence."""
    out = None
    for rank, (name, rows) in enumerate(sources.items()):
        one = rows.select(F.lower(F.trim("label")).alias("label"), "module_id", F.lit(name).alias("origin"), F.lit(rank).alias("_rank"))
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("label").orderBy(F.desc("_rank"), "module_id")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def graph_links(scores: DataFrame, evidence: DataFrame, default: float = 0.5) -> DataFrame:
    """(employee_id, capability_id, weight): positive scores, and a default for pairs with evidence but no score."""
    scored = scores.select("employee_id", "capability_id", F.col("score").alias("weight"))
    seen = evidence.select("employee_id", "capability_id").distinct()
    rest = seen.join(scored, ["employee_id", "capability_id"], "left_anti").withColumn("weight", F.lit(default))
    return scored.where("weight > 0").unionByName(rest)


def difference(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of one table only, and of which: unexpected or missing."""
    extra = found.exceptAll(expected).withColumn("side", F.lit("unexpected"))
    return extra.unionByName(expected.exceptAll(found).withColumn("side", F.lit("missing")))


def like_automation(identifier: Column) -> Column:
    """Whether an identifier looks like a machine's; a hint only, nothing is excluded by it."""
    value = F.lower(F.trim(F.coalesce(identifier, F.lit(""))))
    return (value.endswith("]") & value.contains("[")) | F.split(value, "@")[0].isin(*AUTOMATION_NAMES)


def wanted_spaces(spaces: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Spaces of the configured keys, in any case; all if none is configured."""
    return spaces.where(F.upper("space_key").isin(*(k.upper() for k in keys))) if keys else spaces


def mapping_state(mapping: DataFrame) -> DataFrame:
    """Adds resolved: a service is set, by hand or by a clear lead."""
    return mapping.withColumn("resolved", F.col("service").isNotNull() & F.col("status").isin("manual", "auto"))


def explanations(scores: DataFrame, method: str = "noisy_or") -> DataFrame:
    """(employee_id, capability_id, explanation): why somebody has a band."""
    said = F.format_string(
        "%s has %s credibility (%s) for '%s' based on %d piece(s) of evidence spanning %s to %s. Aggregation method: " + method + ".",
        F.col("employee_id").cast("string"), F.col("band"), F.format_number("score", 6), F.col("capability_id"), F.col("evidence_count"),
        F.col("first_demonstrated").cast("string"), F.col("last_demonstrated").cast("string"),
    )
    return scores.select("employee_id", "capability_id", said.alias("explanation"))


def gap_sentences(simulated: DataFrame) -> DataFrame:
    """(capability_id, sentence): what is left of a capability, and whether the absence did it."""
    two = lambda c: F.format_number(c, 2)
    left = F.concat(F.lit("Residual coverage only ("), "after_band", F.lit(", "), two("after"), F.lit(")."))
    head = F.when(F.col("after_band") == "NONE", "Nobody who remains covers this capability.").otherwise(left)
    fell = F.concat(F.lit(" Coverage fell from "), "before_band", F.lit(" ("), two("before"), F.lit(") to "), "after_band", F.lit(" ("), two("after"), F.lit(")."))
    same = F.concat(F.lit(" It was at "), "before_band", F.lit(" already."))
    keeps = F.concat(F.lit("Coverage remains "), "after_band", F.lit(" ("), two("after"), F.lit(")."))
    said = F.when(~F.col("gap"), keeps).otherwise(F.concat(head, F.when(F.col("before_band") != F.col("after_band"), fell).otherwise(same)))
    return simulated.select("capability_id", said.alias("sentence"))


def employee_profiles(people: DataFrame, scores: DataFrame) -> DataFrame:
    """(employee_id, name, capabilities): each with the scores as an array of structs in order of the capability; none is empty."""
    one = F.struct("capability_id", "score", "band")
    held = scores.groupBy("employee_id").agg(F.array_sort(F.collect_list(one)).alias("capabilities"))
    empty = F.array().cast("array<struct<capability_id:string,score:double,band:string>>")
    return people.join(held, "employee_id", "left").withColumn("capabilities", F.coalesce("capabilities", empty))


def service_capabilities(modules: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(service, capability_id) over the service's modules, distinct."""
    return modules.join(capabilities, "module_id").select("service", "capability_id").distinct()


def incident_details(payload: Column) -> Column:
    """The first of three places that holds a details object with anything in it."""
    places = ("$.first_trigger_log_entry.channel.details", "$.details", "$.body.details")
    found = [F.get_json_object(payload, p) for p in places]
    return F.coalesce(*(F.when(f.startswith("{") & (f != "{}"), f) for f in found))


def incident_event(payload: Column) -> Column:
    """Title, service, severity and time of a paging service's incident, each from the first place that has it."""
    inner = incident_details(payload)
    at = lambda *p: F.coalesce(*(F.nullif(F.trim(F.get_json_object(payload, x)), F.lit("")) for x in p))
    own = lambda name: F.nullif(F.trim(F.get_json_object(inner, f"$.{name}")), F.lit(""))
    severity = F.coalesce(own("severity"), F.when(at("$.urgency") == "high", "SEV-1").otherwise("SEV-3"))
    return F.struct(
        F.coalesce(own("title"), at("$.title", "$.summary"), F.lit("Untitled incident")).alias("title"),
        F.coalesce(own("service"), at("$.service.summary", "$.service.id")).alias("service"), severity.alias("severity"),
        F.coalesce(own("timestamp"), at("$.created_at")).alias("timestamp"),
    )


def incident_people(incidents: DataFrame, handles: DataFrame) -> DataFrame:
    """(incident_id, employee_id): the lead if known, else the assignee by address, name and id in this order.

    incidents has incident_id, lead_id, email, name, native_id; handles handle (lower case) and employee_id.
    """
    tries = F.array(*(F.struct(F.lit(n).alias("rank"), F.lower(c).alias("handle")) for n, c in enumerate(("email", "name", "native_id"))))
    asked = incidents.where("lead_id IS NULL").select("incident_id", F.explode(tries).alias("t")).select("incident_id", "t.*")
    hit = asked.join(handles, "handle").groupBy("incident_id").agg(F.min_by("employee_id", "rank").alias("found"))
    return incidents.join(hit, "incident_id", "left").select("incident_id", F.coalesce("lead_id", "found").alias("employee_id"))
