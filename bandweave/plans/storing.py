"""Plans of what is stored and read back: normalisation, atomic datasets, the world, lists of people, names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bands, discovery, graph, normalisation, world
from ..sources import blueprint, datasets
from ..storage import delete, shared_dir
from .bindings import LINE_DAY, day, edges, edges_sql
from .extracting import _commits
from .registry import plan, read


def _folder(spark, name):
    return f"{shared_dir(spark)}/bandweave/{name}-{uuid.uuid4().hex}"


_NORMALISED = """
    b AS (SELECT event_id AS rec, CASE WHEN event_id % 3 > 0 THEN 'U' || user_id || '@x.org' ELSE 'l' || user_id END AS a, user_id AS u FROM events
          WHERE event_id % 40 NOT IN (7, 8, 9)),
    r AS (SELECT rec, a AS actor, CASE WHEN rec % 5 = 0 THEN 'merger_only' ELSE 'author' END AS role FROM b
        UNION SELECT rec, 'bo@x.org', 'author' FROM b WHERE rec % 5 > 0 AND rec % 2 = 0
        UNION SELECT rec, 'U' || u || '@x.org', 'author' FROM b WHERE rec % 5 > 0 AND rec % 2 = 0 AND rec % 3 = 0),
    w AS (SELECT r.rec, actor, role, u, CASE WHEN actor = 'bo@x.org' THEN 'Bo' WHEN actor LIKE 'U%' AND u % 3 < 2 THEN 'E' || u END AS employee_id,
              CASE WHEN actor = 'bo@x.org' OR actor LIKE 'U%' AND u % 3 = 0 THEN 'exact' WHEN actor LIKE 'U%' AND u % 3 = 1 THEN 'email' ELSE 'unmapped' END AS rung FROM r JOIN b USING (rec)),
    n AS (SELECT rec AS record_id, actor, role, employee_id, rung, CASE WHEN actor = 'bo@x.org' THEN 'bot' WHEN role = 'merger_only' THEN 'merger_only' END AS exclusion_reason FROM w)
"""


def _records(spark, d):
    """A commit for each event; of forty one is cut short, one is no object and one has text where files should be."""
    k = F.col("record_id") % 40
    broken = (
        F.when(k == 7, F.expr("substring(payload, 1, length(payload) - 3)")).when(k == 8, '["no", "object"]')
        .when(k == 9, '{"commit": {"message": "fix"}, "files": "none"}').otherwise(F.col("payload"))
    )
    return _commits(spark, d).select("record_id", F.lit("github").alias("source"), F.concat(F.lit("c"), F.col("record_id").cast("string")).alias("native_id"), broken.alias("payload"))


def _people(spark, d):
    """Every third user is known by the exact address, every third by one in lower case; Bo is a service account."""
    u = F.col("user_id")
    known = read(spark, d, "events").select(u).distinct().where(u % 3 < 2).select(
        F.lit("github").alias("source"), F.concat(F.when(u % 3 == 0, "U").otherwise("u"), u, F.lit("@x.org")).alias("native_id"), F.concat(F.lit("E"), u).alias("employee_id"))
    bo = spark.createDataFrame([("github", "bo@x.org", "Bo")], known.schema)
    return known.unionByName(bo), bo.select("employee_id")


@plan("prj23_normalised_rows", f"WITH {_NORMALISED} SELECT record_id, actor, role, employee_id, rung, exclusion_reason FROM n")
def prj23_rows(spark, d):
    found = normalisation.normalised(_records(spark, d), *_people(spark, d))[0]
    return found.select("record_id", "actor", "role", "employee_id", "rung", "exclusion_reason")


@plan("prj23_bad_records", """
    SELECT event_id AS record_id, 'c' || event_id AS native_id, CASE event_id % 40 WHEN 7 THEN 'not JSON' WHEN 8 THEN 'not an object' ELSE 'a field of another shape' END AS error
    FROM events WHERE event_id % 40 IN (7, 8, 9)
""")
def prj23_errors(spark, d):
    return normalisation.normalised(_records(spark, d), *_people(spark, d))[1].select("record_id", "native_id", "error")


_TWICE = ("rows", "inserted", "skipped", "eligible", "unmapped", "unmapped_harmless", "excluded_bot", "excluded_merger_only", "identity_exact", "identity_email", "errors")


@plan("prj23_counters_of_two_runs", f"""
    WITH {_NORMALISED}, c AS (SELECT count(*) AS rows, count_if(exclusion_reason IS NULL) AS eligible, count_if(employee_id IS NULL AND exclusion_reason IS NULL) AS unmapped,
        count_if(employee_id IS NULL AND exclusion_reason IS NOT NULL) AS unmapped_harmless, count_if(exclusion_reason = 'bot') AS excluded_bot,
        count_if(exclusion_reason = 'merger_only') AS excluded_merger_only, count_if(rung = 'exact') AS identity_exact, count_if(rung = 'email') AS identity_email FROM n),
    b2 AS (SELECT count(*) AS errors FROM events WHERE event_id % 40 IN (7, 8, 9))
    SELECT run, rows, CASE run WHEN 1 THEN rows ELSE 0 END AS inserted, CASE run WHEN 1 THEN 0 ELSE rows END AS skipped, eligible, unmapped, unmapped_harmless,
        excluded_bot, excluded_merger_only, identity_exact, identity_email, errors FROM c CROSS JOIN b2 CROSS JOIN (VALUES (1), (2)) t(run)
""")
def prj23_counters(spark, d):
    """The second run over the same records inserts nothing."""
    folder, (identities, bots) = _folder(spark, "items"), _people(spark, d)
    runs = [normalisation.normalise_into(_records(spark, d), identities, bots, folder) for _ in range(2)]
    delete(spark, folder)
    return spark.createDataFrame([(k + 1, *(run[c] for c in _TWICE)) for k, run in enumerate(runs)], f"run int, {', '.join(f'{c} bigint' for c in _TWICE)}")


@plan("snk06_replaced_dataset", "SELECT event_id, event_type, value FROM events")
def snk06(spark, d):
    """A part of the events, then all of them in its place; a third that fails its count changes nothing."""
    folder, e = _folder(spark, "raw"), read(spark, d, "events").select("event_id", "event_type", "value")
    datasets.replace(e.where("value > 50"), folder)
    datasets.replace(e, folder, expected=e.count())
    try:
        datasets.replace(e.where("value > 50"), folder, expected=-1)
    except ValueError:
        return datasets.read(spark, folder)
    raise AssertionError("a wrong count was accepted")


@plan("snk07_normalised_dataset", """
    SELECT event_id AS record_id, 'lu' || user_id AS actor, 'assigned_no_detail' AS role, 'service:' || event_type AS tokens FROM events
""")
def snk07(spark, d):
    """Incidents with a responder each: as many rows as records, or nothing is put in place."""
    from ..operators import ladders

    e = read(spark, d, "events")
    payload = F.to_json(F.struct(F.struct(F.col("event_type").alias("id")).alias("service"), F.concat(F.lit("lu"), F.col("user_id")).alias("responder")))
    raw = e.select(F.col("event_id").alias("record_id"), payload.alias("payload"))
    folder = _folder(spark, "incidents")
    rows = ladders.incident_rows(raw).select("record_id", "actor", "role", F.array_join("tokens", ",").alias("tokens"))
    datasets.replace(rows, folder, "json", expected=raw.count())
    return datasets.read(spark, folder, "json").select(F.col("record_id").cast("bigint").alias("record_id"), "actor", "role", "tokens")


_PLAIN = edges_sql()
_CUT = _PLAIN.index("br AS (")
_LINKED = f"""{_PLAIN[:_CUT].replace("e AS (", "e0 AS (", 1)}
    e AS (SELECT e0.* REPLACE (least(certainty_cap, CASE WHEN item_id % 10 > 5 THEN 2 ELSE 3 END) AS certainty_cap) FROM e0
          WHERE item_id % 10 <> 7 AND person <> 5 AND effort IS DISTINCT FROM 50),
    {_PLAIN[_CUT:]}"""


def _linked(spark, d):
    """Items with an employee and a certainty; orders as units; parts as nodes below brands; the seventh lines wait for review."""
    rows = edges(spark, d, "p_partkey").withColumn("line_id", F.col("item_id"))
    rows = rows.withColumn("item_id", F.xxhash64("line_id", "person", "capability", "occurred_at", "effort", "role", "certainty"))  # line numbers repeat
    items = rows.select(
        "item_id", "line_id", F.nullif("person", F.lit(5)).alias("employee_id"), (F.coalesce("effort", F.lit(0.0)) != 50).alias("eligible"), "certainty", "source", "role",
        "occurred_at", "effort")
    line = F.col("line_id") % 10
    members = rows.select(
        "item_id", F.col("capability").alias("node"), F.when(line > 5, "probable").otherwise("certain").alias("certainty"),
        F.when(line == 7, "pending_review").when(line % 2 == 0, "human_approved").otherwise("auto_applied").alias("review_state")).distinct()
    parts = read(spark, d, "part")
    top = F.concat(F.lit("B"), F.col("p_brand"))
    tree = parts.select(F.col("p_partkey").cast("string").alias("node"), top.alias("parent"), F.lit(False).alias("is_start")).unionByName(
        parts.select(top.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("is_start")).distinct())
    below = graph.closure(tree, depth=3).where("hops > 0").select(F.expr("substring(ancestor, 2)").alias("ancestor"), F.col("node").try_cast("bigint").alias("node"))
    return items, rows.select("item_id", "unit").distinct(), members, below


@plan("joi01_evidence_edges", f"WITH {_LINKED} SELECT item_id, person, capability, unit, ['tentative', 'probable', 'certain'][certainty_cap] AS certainty FROM e")
def joi01(spark, d):
    found = world.evidence_edges(*_linked(spark, d))
    return found.select(F.col("line_id").alias("item_id"), F.col("employee_id").alias("person"), "capability", "unit", "certainty")


def _world(spark, d):
    """The tables of a world, written below one folder and loaded at one moment."""
    folder = _folder(spark, "world")
    nations = read(spark, d, "nation").select("n_nationkey")
    people = read(spark, d, "supplier").select(F.col("s_suppkey").alias("employee_id"), F.when(F.col("s_acctbal") > 0, "active").otherwise("departed").alias("status"), (F.col("s_suppkey") % 10 == 7).alias("is_service_account"))
    found = world.evidence_edges(*_linked(spark, d))
    tables = {
        "edges": found, "capabilities": read(spark, d, "part").select(F.col("p_brand").alias("capability")).distinct(),
        "components": read(spark, d, "part").select(F.col("p_brand").alias("capability"), F.col("p_type").alias("component")).distinct(),
        "employees": people, "dependencies": nations.select(F.col("n_nationkey").alias("source"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("target")),
        "ceilings": bands.role_ceilings(spark), "units": found.groupBy("unit").agg(F.max("occurred_at").alias("occurred_at")),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    return world.load_world(spark, folder)


@plan("src22_world_bands", f"""
    WITH {_LINKED} SELECT capability, band_code, count(*) AS people FROM bd JOIN supplier ON s_suppkey = person WHERE s_acctbal > 0 AND s_suppkey % 10 <> 7 GROUP BY 1, 2
""")
def src22(spark, d):
    """Bands of the coverage set, from the edges of a world."""
    found = _world(spark, d)
    rows = found.edges.withColumnRenamed("employee_id", "person")
    capped = bands.ceilings(rows, day(LINE_DAY), F.lit(5), F.lit(7), F.lit(5.0))
    mine = bands.assign(capped, day(LINE_DAY)).join(found.coverage_set().withColumnRenamed("employee_id", "person"), "person", "left_semi")
    return mine.groupBy("capability", "band_code").agg(F.count("*").alias("people"))


def _blueprint(spark, d):
    """A list of suppliers a nation, as text: every seventh without a name, some quoted, some with comments and a second address."""
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    n = k.cast("string")
    lines = F.array(
        text("  - id: E", n), F.when(k % 7 > 0, text('    full_name: "', F.col("s_name"), '"')).otherwise("    full_name:"),
        text("    email: M", n, "@x.org"), F.lit("    # github_handle: nobody"), F.lit("a line without a colon: ").substr(1, 21),
        F.when(k % 3 == 0, text("    github_handle: 'Hub", n, "'")).otherwise("    role: engineer"), text("    incident_alias: shared"),
    )
    block = F.array_join(lines, "\n")
    by = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, block.alias("b")))), lambda x: x["b"]), "\n").alias("b"))
    folder = _folder(spark, "people")
    body = by.select(F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("nation"), F.concat(F.lit("version: 1\nemployees:\n"), "b", F.lit("\n")).alias("value"))
    body.repartition("nation").write.partitionBy("nation").option("lineSep", "\x00").text(folder)
    return blueprint.people(blueprint.read_lines(spark, folder).withColumn("text", F.translate("text", "\x00", "")))


@plan("src24_people_handles", """
    WITH p AS (SELECT s_suppkey AS k, s_nationkey AS n, 'E' || s_suppkey AS id, s_name FROM supplier WHERE s_suppkey % 7 > 0),
    h AS (SELECT lower(id) AS handle, id, n, k, 0 AS o FROM p UNION ALL SELECT lower(s_name), id, n, k, 1 FROM p
        UNION ALL SELECT 'm' || k || '@x.org', id, n, k, 2 FROM p UNION ALL SELECT 'm' || k, id, n, k, 3 FROM p
        UNION ALL SELECT 'hub' || k, id, n, k, 5 FROM p WHERE k % 3 = 0 UNION ALL SELECT 'shared', id, n, k, 6 FROM p)
    SELECT handle, arg_max(id, n::BIGINT * 1000000000 + k * 10 + o) AS employee_id FROM h GROUP BY handle
""")
def src24_handles(spark, d):
    return blueprint.handles(_blueprint(spark, d))


@plan("src24_people_names", """
    SELECT unnest(['E' || s_suppkey, 'e' || s_suppkey]) AS key, s_name AS name FROM supplier WHERE s_suppkey % 7 > 0
""")
def src24_names(spark, d):
    return blueprint.names(_blueprint(spark, d))


@plan("qry19_name_tree", """
    WITH RECURSIVE p AS (
        SELECT p_partkey AS node, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN p_name || ' one two three four five' WHEN 2 THEN 'Misc ' || p_brand
            WHEN 3 THEN p_type || ' ' || p_size WHEN 4 THEN 'Capability ' || (p_partkey % 10) ELSE p_brand END AS name,
            row_number() OVER (ORDER BY p_partkey) AS i FROM part
    ), t(i, node, name, taken) AS (
        SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::VARCHAR[]
        UNION ALL SELECT p.i, p.node, x.name, list_append(taken, trim(x.name)) FROM t JOIN p ON p.i = t.i + 1, LATERAL (
            SELECT CASE WHEN trim(p.name) = '' OR length(trim(p.name)) > 48 OR len(string_split_regex(trim(p.name), '\\s+')) > 5 OR lower(p.name) LIKE '%misc%'
                OR regexp_full_match(trim(p.name), 'Capability \\d+') AND trim(p.name) <> 'Capability ' || p.node OR list_contains(taken, trim(p.name))
                THEN 'Capability ' || p.node ELSE p.name END AS name) x
    ) SELECT node, name FROM t WHERE i > 0
""")
def qry19(spark, d):
    """Parts as nodes that take their turn by number."""
    k = F.col("p_partkey") % 6
    name = (
        F.when(k == 0, "").when(k == 1, F.concat("p_name", F.lit(" one two three four five"))).when(k == 2, F.concat(F.lit("Misc "), "p_brand"))
        .when(k == 3, F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))).when(k == 4, F.concat(F.lit("Capability "), (F.col("p_partkey") % 10).cast("string")))
        .otherwise(F.col("p_brand"))
    )
    return discovery.name_tree(read(spark, d, "part").select(F.col("p_partkey").alias("node"), name.alias("name")), ("misc",)).select("node", "name")
