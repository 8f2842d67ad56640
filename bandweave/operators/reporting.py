"""Reports over edges, bands and records, with the columns named that they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

UNITS, CONTRIBUTORS, RECORDS, FIRST = 50, 12, 50, 3


def _listed(c: str) -> Column:
    """The different values in order, as text."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda v: v.cast("string")), ",")


def unit_breadth(edges: DataFrame) -> DataFrame:
    """(unit, n): capabilities that a unit touches."""
    return edges.groupBy("unit").agg(F.countDistinct("capability").alias("n"))


def unit_list(edges: DataFrame, top: int = UNITS) -> DataFrame:
    """(unit, members, last_at, people, capabilities, roles) of the largest and latest units."""
    first = edges.groupBy("unit").agg(F.count("*").alias("members"), F.max("occurred_at").alias("last_at"))
    first = first.orderBy(F.desc("members"), F.desc("last_at"), "unit").limit(top)
    named = edges.join(F.broadcast(first.select("unit")), "unit").groupBy("unit").agg(  # top rows
        _listed("person").alias("people"), _listed("capability").alias("capabilities"), _listed("role").alias("roles")
    )
    return first.join(named, "unit")


def contaminated_units(items: DataFrame) -> DataFrame:
    """(unit, sources): units whose items (unit, source) come from more than one source."""
    return items.groupBy("unit").agg(F.countDistinct("source").alias("sources")).where("sources > 1")


def source_report(items: DataFrame) -> DataFrame:
    """(source, records, items, eligible, excluded) of items (source, record_id, eligible)."""
    return items.groupBy("source").agg(
        F.countDistinct("record_id").alias("records"), F.count("*").alias("items"), F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("excluded")
    )


def source_status(rows: DataFrame, first: int = FIRST) -> DataFrame:
    """(source, done, waiting, sample) of rows (source, actor, done): sample names the first actors."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("actor"))
    few = rows.select("source", "actor").distinct().withColumn("_p", place).where(F.col("_p") <= first)
    sample = few.groupBy("source").agg(_listed("actor").alias("sample"))
    return rows.groupBy("source").agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("waiting")).join(sample, "source")


def top_contributors(items: DataFrame, top: int = CONTRIBUTORS) -> DataFrame:
    """(person, n, sources) of the people of most items (person, source)."""
    found = items.groupBy("person").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    return found.orderBy(F.desc("n"), "person").limit(top)


def contributors(people: DataFrame, records: DataFrame, domain: str) -> DataFrame:
    """(id, name, email, records) of all people (id, name), with an address made of the name and the number of their records (id)."""
    counts = records.groupBy("id").agg(F.count("*").alias("records"))
    email = F.concat(F.replace(F.lower("name"), F.lit(" "), F.lit(".")), F.lit(f"@{domain}"))
    return people.join(counts, "id", "left").select("id", "name", email.alias("email"), F.coalesce("records", F.lit(0)).alias("records"))


def first_records(records: DataFrame, first: int = FIRST) -> DataFrame:
    """(id, records, first) of records (id, k, line): how many there are, and the lines of the first by k."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("k", "line"))
    few = records.withColumn("_n", place).where(F.col("_n") <= first)
    lines = few.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), ",").alias("first"))
    return records.groupBy("id").agg(F.count("*").alias("records")).join(lines, "id")


def broken_references(checks: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(check_name, broken): for each check how many keys of its first table, a column, its second doesn't have; null keys are broken."""
    out = None
    for name, (rows, known) in checks.items():
        missing = rows.toDF("_key").join(known.toDF("_known").distinct(), F.col("_key") == F.col("_known"), "left_anti")
        one = missing.agg(F.lit(name).alias("check_name"), F.count("*").alias("broken"))
        out = one if out is None else out.unionByName(one)
    return out


def coverage_set(employees: DataFrame) -> DataFrame:
    """(person) of employees (person, status, is_service_account) who count: active, and no service account."""
    return employees.where("status = 'active' AND NOT is_service_account").select("person")


def coverage_map(bands: DataFrame) -> DataFrame:
    """(capability, people): who holds any band, by name."""
    return bands.where("band_code > 0").groupBy("capability").agg(_listed("person").alias("people"))


def strongest_bands(bands: DataFrame) -> DataFrame:
    return bands.groupBy("person").agg(F.max("band_code").alias("band_code"))


def mark_unavailable(bands: DataFrame, person) -> DataFrame:
    """(capability, before, after, status) of what the person holds: the best band with and without them."""
    mine = bands.where((F.col("person") == F.lit(person)) & (F.col("band_code") > 0)).select("capability")
    left = F.max(F.when(F.col("person") != F.lit(person), F.col("band_code")))
    both = bands.join(mine, "capability", "left_semi").groupBy("capability").agg(F.max("band_code").alias("before"), F.coalesce(left, F.lit(0)).alias("after"))
    status = F.when(F.col("after") == 0, "Lost").when(F.col("after") < F.col("before"), "Degraded").otherwise("Maintained")
    return both.withColumn("status", status)


def employee_list(people: DataFrame, bands: DataFrame) -> DataFrame:
    """(person, name, capabilities, high, best) of all people (person, name)."""
    return people.join(bands, "person", "left").groupBy("person", "name").agg(
        F.count("capability").alias("capabilities"), F.count_if(F.col("band_code") == 3).alias("high"), F.coalesce(F.max("band_code"), F.lit(0)).alias("best")
    )


def record_details(records: DataFrame, people: DataFrame, units: DataFrame) -> DataFrame:
    """records (record_id, person_id) with what is known of them: people (person_id, employee, unit_id, ...) and units (unit_id, unit); the rest is null."""
    return records.join(people, "person_id", "left").join(units, "unit_id", "left")


def record_counts(records: DataFrame, items: DataFrame) -> DataFrame:
    """(record_id, items, eligible, people, last_at) of every record, from items (record_id, eligible, person, occurred_at)."""
    by = items.groupBy("record_id").agg(
        F.count("*").alias("items"), F.count_if("eligible").alias("eligible"), F.countDistinct("person").alias("people"), F.max("occurred_at").alias("last_at")
    )
    return records.select("record_id").join(by, "record_id", "left").fillna(0, ["items", "eligible", "people"])


def record_search(records: DataFrame, wanted: str | None, people: DataFrame | None, top: int = RECORDS) -> DataFrame:
    """The latest records (record_id, person, title, occurred_at) whose title contains the text, in any case, of any of the people; a filter that isn't given doesn't filter."""
    found = records
    if wanted is not None:
        found = found.where(F.contains(F.lower("title"), F.lit(wanted.lower())))
    if people is not None:
        found = found.join(people.select("person"), "person", "left_semi")
    return found.orderBy(F.desc_nulls_last("occurred_at"), F.desc("record_id")).limit(top)


def module_context(modules: DataFrame) -> DataFrame:
    """(capability_id, modules, n) of modules (capability_id, module)."""
    return modules.groupBy("capability_id").agg(_listed("module").alias("modules"), F.count("*").alias("n"))


def evidence_graph(bands: DataFrame, absent) -> DataFrame:
    """(kind, id, target, faded): people, capabilities and the links between them; what the absence takes away is faded."""
    gone, name, none = F.col("person") == F.lit(absent), F.col("person").cast("string"), F.lit(None).cast("string").alias("target")
    people = bands.select(F.lit("person").alias("kind"), name.alias("id"), none, gone.alias("faded")).distinct()
    held = bands.groupBy("capability").agg(F.bool_and(gone | (F.col("band_code") == 0)).alias("faded"))
    caps = held.select(F.lit("capability").alias("kind"), F.col("capability").alias("id"), none, "faded")
    links = bands.where("band_code > 0").select(F.lit("edge").alias("kind"), name.alias("id"), F.col("capability").alias("target"), gone.alias("faded"))
    return people.unionByName(caps).unionByName(links)


def dependency_graph(nodes: DataFrame, links: DataFrame, origin) -> DataFrame:
    """nodes (component, ...) with exposure to the origin, by the shortest way, and how many they depend on; links (source, target) are distinct."""
    hops = graph.exposure(nodes.where(F.col("component") == F.lit(origin)).select("component"), links)
    out = nodes.join(hops, "component", "left").join(links.groupBy(F.col("source").alias("component")).agg(F.count("*").alias("depends_on")), "component", "left")
    shown = F.when(F.col("component") == F.lit(origin), "ORIGIN").when(F.col("hop") == 1, "DIRECT").when(F.col("hop") == 2, "SECOND").otherwise("NONE")
    return out.withColumns({"exposure": shown, "depends_on": F.coalesce("depends_on", F.lit(0))}).drop("hop")


def containment(levels: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, parent, kind) of the levels of a hierarchy, each (kind, rows of id and parent)."""
    out = None
    for kind, rows in levels:
        one = rows.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"), F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out
