"""Plans of the composite queries over bands: calibration, overviews, holders, departures, drill-downs, graphs of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bands, reporting, teams
from ..storage import stored
from .bindings import DEPENDENCIES, EDGES, LINE_DAY, day, dependencies, edges, edges_sql
from .ordinal import _bands
from .registry import plan, read

_CALIBRATED = """
    cal AS (SELECT * FROM
        (SELECT max(occurred_at) AS as_of FROM e),
        (SELECT list_sort(list(effort))[round_even(0.1 * (count(effort) - 1), 0)::INT + 1]::DOUBLE AS p10_effort FROM e WHERE effort > 0),
        (SELECT list_sort(list(breadth))[round_even(0.9 * (count(*) - 1), 0)::INT + 1]::DOUBLE AS p90_breadth,
                list_sort(list(breadth))[round_even(0.98 * (count(*) - 1), 0)::INT + 1]::DOUBLE AS p98_breadth FROM br),
        (SELECT list_sort(list(n))[round_even(0.25 * (count(*) - 1), 0)::INT + 1]::DOUBLE AS p25_units
         FROM (SELECT count(DISTINCT unit) AS n FROM e GROUP BY capability))),
"""
_FROZEN = edges_sql("(SELECT p90_breadth FROM cal)", "(SELECT p98_breadth FROM cal)", "(SELECT p10_effort FROM cal)", before=_CALIBRATED)


@plan("agg15_calibration", f"WITH {_FROZEN} SELECT * FROM cal")
def agg15(spark, d):
    return bands.calibration(edges(spark, d))


@plan("qry16_frozen_bands", f"WITH {_FROZEN} SELECT capability, band_code, count(*) AS n FROM bd GROUP BY 1, 2")
def qry16(spark, d):
    """Bands under thresholds that come from the data: calibrate, then cap."""
    rows = edges(spark, d)
    units = stored(bands.units(rows), "units")
    known = bands.thresholds(rows, units).first()  # three numbers
    capped = bands.ceilings(rows, day(LINE_DAY), F.lit(known.p90_breadth), F.lit(known.p98_breadth), F.lit(known.p10_effort), units)
    return bands.assign(capped, day(LINE_DAY)).groupBy("capability", "band_code").agg(F.count("*").alias("n"))


@plan("joi25_holders", f"""
    WITH {EDGES} SELECT capability, person, band_code, person % 5 = 0 AS departed,
        row_number() OVER (PARTITION BY capability, person % 5 = 0 ORDER BY band_code DESC, person) AS place FROM bd WHERE band_code > 0
""")
def joi25(spark, d):
    return bands.holders(_bands(spark, d), F.col("person") % 5 == 0)


@plan("agg35_strongest_band", f"WITH {EDGES} SELECT person, max(band_code) AS band_code FROM bd GROUP BY person")
def agg35(spark, d):
    return reporting.strongest_bands(_bands(spark, d))


@plan("agg33_coverage_map", f"WITH {EDGES} SELECT capability, string_agg(person, ',' ORDER BY person) AS people FROM bd WHERE band_code > 0 GROUP BY capability")
def agg33(spark, d):
    return reporting.coverage_map(_bands(spark, d))


@plan("qry10_sole_coverers", f"""
    WITH {edges_sql(capability="p_partkey")}, c AS (SELECT capability, count(*) AS n, min(person) AS person FROM bd WHERE band_code >= 2 GROUP BY capability)
    SELECT person, capability FROM c WHERE n = 1
""")
def qry10(spark, d):
    """Single parts as capabilities: many of them have one coverer."""
    capped = bands.ceilings(edges(spark, d, "p_partkey"), day(LINE_DAY), F.lit(5), F.lit(7), F.lit(5.0))
    return bands.sole_coverers(bands.coverage(bands.assign(capped, day(LINE_DAY)), 2))


@plan("qry05_headline", f"""
    WITH {EDGES}, t AS (SELECT capability, count(*) FILTER (WHERE band_code = 3) AS n FROM bd GROUP BY capability)
    SELECT count(*) FILTER (WHERE n = 0) || ' uncovered and ' || count(*) FILTER (WHERE n = 1) || ' with a single coverer of ' || count(*) || ' capabilities' AS headline FROM t
""")
def qry05_headline(spark, d):
    return bands.risk_headline(bands.coverage(_bands(spark, d), 3))


@plan("qry04_overview", f"""
    WITH {EDGES}, t AS (SELECT capability, count(*) FILTER (WHERE band_code >= 2) AS n_coverers, max(band_code) AS best_band FROM bd GROUP BY capability),
    a AS (SELECT capability, bool_or(date_diff('day', unit_at, DATE '2001-11-05') / 30.44 <= 12) AS active, count(DISTINCT unit) < 300 AS is_thin
          FROM e JOIN br USING (unit) GROUP BY capability)
    SELECT capability, n_coverers, best_band, concat_ws(', ', CASE n_coverers WHEN 0 THEN 'uncovered' WHEN 1 THEN 'single' ELSE 'covered' END,
        CASE WHEN NOT active THEN 'dormant' END, CASE WHEN is_thin THEN 'thin' END) AS state FROM t JOIN a USING (capability)
""")
def qry04(spark, d):
    return bands.overview(_bands(spark, d), edges(spark, d), day(LINE_DAY), 300).select("capability", "n_coverers", "best_band", "state")


@plan("qry09_capability_detail", f"""
    WITH {EDGES} SELECT capability, count(DISTINCT person) AS people, count(DISTINCT unit) AS units, count(*) AS items, max(unit_at) AS last_at,
        count(*) FILTER (WHERE ceiling = 3) AS high_items FROM cl GROUP BY capability
""")
def qry09(spark, d):
    found = bands.ceilings(edges(spark, d), day(LINE_DAY), F.lit(5), F.lit(7), F.lit(5.0))
    return found.groupBy("capability").agg(
        F.countDistinct("person").alias("people"), F.countDistinct("unit").alias("units"), F.count("*").alias("items"),
        F.max("unit_at").alias("last_at"), F.count_if(F.col("ceiling") == 3).alias("high_items"),
    )


@plan("qry11_employee_list", f"""
    WITH {EDGES} SELECT s_suppkey AS person, s_name AS name, count(bd.capability) AS capabilities, count(*) FILTER (WHERE band_code = 3) AS high,
        coalesce(max(band_code), 0) AS best FROM supplier LEFT JOIN bd ON bd.person = s_suppkey GROUP BY 1, 2
""")
def qry11(spark, d):
    people = read(spark, d, "supplier").select(F.col("s_suppkey").alias("person"), F.col("s_name").alias("name"))
    return reporting.employee_list(people, _bands(spark, d))


@plan("qry20_mark_unavailable", f"""
    WITH {EDGES}, h AS (SELECT capability FROM bd WHERE person = 3 AND band_code > 0),
    t AS (SELECT capability, max(band_code) AS before, coalesce(max(band_code) FILTER (WHERE person <> 3), 0) AS after FROM bd
          WHERE capability IN (SELECT capability FROM h) GROUP BY capability)
    SELECT capability, before, after, CASE WHEN after = 0 THEN 'Lost' WHEN after < before THEN 'Degraded' ELSE 'Maintained' END AS status FROM t
""")
def qry20(spark, d):
    """Only what the person has: the best band before and after."""
    return reporting.mark_unavailable(_bands(spark, d), 3)


@plan("opt05_departure_targets", f"WITH {EDGES} SELECT capability FROM bd WHERE person = 3 AND band_code >= 2")
def opt05(spark, d):
    return bands.departure_targets(_bands(spark, d), 3)


@plan("opt06_candidate_matrix", f"""
    WITH {EDGES}, t AS (SELECT capability FROM bd WHERE person = 3 AND band_code >= 2)
    SELECT s_suppkey AS person, t.capability, coalesce(band_code, 0) AS band_code, coalesce(band_code, 0) >= 2 AS qualified
    FROM supplier CROSS JOIN t LEFT JOIN bd ON bd.person = s_suppkey AND bd.capability = t.capability WHERE s_suppkey <> 3
""")
def opt06_matrix(spark, d):
    found = _bands(spark, d)
    people = read(spark, d, "supplier").select(F.col("s_suppkey").alias("person"))
    return bands.candidate_matrix(found, people, bands.departure_targets(found, 3), 3)


@plan("str26_why_sentences", f"""
    WITH {EDGES}, o AS (SELECT capability FROM bd GROUP BY capability HAVING max(band_code) < 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY band_code DESC, person) AS n FROM bd WHERE band_code > 0 AND capability IN (SELECT capability FROM o))
    SELECT capability, 'Nobody covers ' || capability || '; closest is ' || person || ' at ' || ['NONE', 'LOW', 'MODERATE', 'HIGH'][band_code + 1] AS why FROM r WHERE n = 1
""")
def str26(spark, d):
    found = _bands(spark, d)
    return bands.why_open(teams.closest_candidates(found, bands.coverage(found, 3).where("n_coverers = 0")))


@plan("str27_rationales", f"""
    WITH {EDGES}, f AS (SELECT capability, min(person) AS person FROM bd WHERE band_code >= 2 GROUP BY capability)
    SELECT person, string_agg(capability || ' at ' || ['NONE', 'LOW', 'MODERATE', 'HIGH'][band_code + 1], '; ' ORDER BY capability) AS rationale
    FROM f JOIN bd USING (person, capability) GROUP BY person
""")
def str27(spark, d):
    found = _bands(spark, d)
    first = found.where("band_code >= 2").groupBy("capability").agg(F.min("person").alias("person"))
    return bands.rationales(found.select("person", "capability", "band_code"), first)


@plan("qry18_rung_coverage", f"""
    WITH {EDGES}, l(role) AS (VALUES ('author'), ('pr_author'), ('reviewer_substantive'), ('reviewer_approval'), ('merger_only'))
    SELECT l.role, count(e.role) AS fired, count(e.role) = 0 AS silent FROM l LEFT JOIN e ON e.role = l.role GROUP BY l.role
""")
def qry18(spark, d):
    """Roles of the source's ladder: how often each fired, and which never did."""
    ladder = bands.role_ceilings(spark).where("source = 'github'").select("role")
    fired = edges(spark, d).groupBy("role").agg(F.count("*").alias("fired"))
    return ladder.join(fired, "role", "left").select("role", F.coalesce("fired", F.lit(0)).alias("fired"), F.col("fired").isNull().alias("silent"))


@plan("joi15_excluded_items", """
    WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS item_id, p_brand, string_split(p_type, ' ') AS tokens, CAST(l_shipdate AS DATE) AS shipped,
                      l_returnflag <> 'R' AS eligible FROM lineitem JOIN part ON l_partkey = p_partkey),
    t AS (SELECT DISTINCT unnest(tokens) AS t FROM i WHERE p_brand = 'Brand#12' AND eligible),
    x AS (SELECT item_id, max(shipped) AS shipped FROM (SELECT item_id, shipped, unnest(tokens) AS t FROM i WHERE NOT eligible) JOIN t USING (t) GROUP BY item_id)
    SELECT item_id, shipped FROM x ORDER BY shipped DESC, item_id LIMIT 25
""")
def joi15(spark, d):
    """Items that were excluded but share a token with a capability's own items, latest first, 25 of them."""
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), "p_brand", F.col("l_shipdate").cast("date").alias("shipped"),
        F.explode(F.split("p_type", " ")).alias("token"), (F.col("l_returnflag") != "R").alias("eligible"),
    )
    own = rows.where("p_brand = 'Brand#12' AND eligible").select("token").distinct()
    shared = rows.where("NOT eligible").join(own, "token", "left_semi").groupBy("item_id").agg(F.max("shipped").alias("shipped"))
    return shared.orderBy(F.desc("shipped"), "item_id").limit(25)


@plan("joi16_record_details", """
    SELECT o_orderkey AS record_id, c_name AS employee, n_name AS unit, CASE WHEN c_acctbal > 0 THEN 'open' END AS state
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 1000 LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3
""")
def joi16(spark, d):
    """Records with whatever is known of them: missing employees and units stay null."""
    people = read(spark, d, "customer").where("c_acctbal > 1000").select(
        F.col("c_custkey").alias("person_id"), F.col("c_name").alias("employee"), F.col("c_nationkey").alias("unit_id"), F.when(F.col("c_acctbal") > 0, "open").alias("state"))
    units = read(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("unit"))
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("person_id"))
    return reporting.record_details(rows, people, units).select("record_id", "employee", "unit", "state")


@plan("joi17_record_list", """
    SELECT o_orderkey AS record_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS items,
        (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R') AS eligible,
        (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS people,
        (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_orderkey = o_orderkey) AS last_at FROM orders
""")
def joi17(spark, d):
    """Counts that every record shows, aggregated once and joined."""
    items = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("record_id"), (F.col("l_returnflag") != "R").alias("eligible"), F.col("l_suppkey").alias("person"), F.col("l_shipdate").cast("date").alias("occurred_at"))
    return reporting.record_counts(read(spark, d, "orders").select(F.col("o_orderkey").alias("record_id")), items)


@plan("agg27_pipeline_report", """
    SELECT l_returnflag AS source, count(DISTINCT l_orderkey) AS records, count(*) AS items, count(*) FILTER (WHERE l_discount > 0.02) AS eligible,
        count(*) FILTER (WHERE l_discount <= 0.02) AS excluded FROM lineitem GROUP BY 1
""")
def agg27(spark, d):
    return reporting.source_report(read(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("record_id"), (F.col("l_discount") > 0.02).alias("eligible")))


@plan("agg28_unit_list", f"""
    WITH {EDGES} SELECT unit, count(*) AS members, max(occurred_at) AS last_at, string_agg(DISTINCT person, ',' ORDER BY person) AS people,
        string_agg(DISTINCT capability, ',' ORDER BY capability) AS capabilities, string_agg(DISTINCT role, ',' ORDER BY role) AS roles
    FROM e GROUP BY unit ORDER BY members DESC, last_at DESC, unit LIMIT 50
""")
def agg28(spark, d):
    """Work units with what they hold, the largest and latest first."""
    return reporting.unit_list(edges(spark, d))


@plan("agg29_contaminated_units", "SELECT l_orderkey AS unit, count(DISTINCT l_returnflag) AS sources FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def agg29(spark, d):
    """Units whose items come from more than one kind of source."""
    return reporting.contaminated_units(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("source")))


@plan("agg30_source_status", """
    SELECT o_orderpriority AS source, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS done, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'P')) AS waiting,
        list_sort(list(DISTINCT o_custkey))[1] || ',' || list_sort(list(DISTINCT o_custkey))[2] || ',' || list_sort(list(DISTINCT o_custkey))[3] AS sample FROM orders GROUP BY 1
""")
def agg30(spark, d):
    return reporting.source_status(read(spark, d, "orders").select(
        F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("actor"), F.col("o_orderstatus").isin("F", "P").alias("done")))


@plan("agg32_top_contributors", """
    SELECT l_suppkey AS person, count(*) AS n, count(DISTINCT l_returnflag) AS sources FROM lineitem GROUP BY 1 ORDER BY n DESC, person LIMIT 12
""")
def agg32(spark, d):
    return reporting.top_contributors(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_returnflag").alias("source")))


@plan("joi18_referential_checks", """
    SELECT 'part' AS check_name, count(*) AS broken FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 40)
    UNION ALL SELECT 'customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)
    UNION ALL SELECT 'order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
    UNION ALL SELECT 'nation', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey <> 2)
""")
def joi18(spark, d):
    """References without a row to point at, by check."""
    t = {n: read(spark, d, n) for n in ("lineitem", "part", "orders", "customer", "nation")}
    return reporting.broken_references({
        "part": (t["lineitem"].select("l_partkey"), t["part"].where("p_size < 40").select("p_partkey")),
        "customer": (t["orders"].select("o_custkey"), t["customer"].where("c_acctbal > 0").select("c_custkey")),
        "order": (t["lineitem"].select("l_orderkey"), t["orders"].select("o_orderkey")),
        "nation": (t["customer"].select("c_nationkey"), t["nation"].where("n_regionkey <> 2").select("n_nationkey")),
    })


@plan("flt08_coverage_set", "SELECT s_suppkey AS person FROM supplier WHERE s_acctbal > 0 AND NOT s_name LIKE '%7'")
def flt08(spark, d):
    """Suppliers in the red have left; names that end in 7 are service accounts."""
    return reporting.coverage_set(read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("person"), F.when(F.col("s_acctbal") > 0, "active").otherwise("departed").alias("status"),
        F.col("s_name").like("%7").alias("is_service_account")))


@plan("gra10_evidence_graph", f"""
    WITH {EDGES} SELECT 'person' AS kind, person::VARCHAR AS id, NULL AS target, person = 3 AS faded FROM (SELECT DISTINCT person FROM bd)
    UNION ALL SELECT 'capability', capability, NULL, bool_and(person = 3 OR band_code = 0) FROM bd GROUP BY capability
    UNION ALL SELECT 'edge', person::VARCHAR, capability, person = 3 FROM bd WHERE band_code > 0
""")
def gra10(spark, d):
    """Nodes and links of people and capabilities; what one person's absence takes away is faded."""
    return reporting.evidence_graph(_bands(spark, d), 3)


@plan("gra11_dependency_graph", f"""
    WITH {DEPENDENCIES}, d1 AS (SELECT DISTINCT source AS c FROM de WHERE target = 4 AND source <> 4),
    d2 AS (SELECT DISTINCT source AS c FROM de WHERE target IN (SELECT c FROM d1) AND source <> 4 AND source NOT IN (SELECT c FROM d1))
    SELECT n_nationkey AS component, n_name AS name, CASE WHEN n_nationkey = 4 THEN 'ORIGIN' WHEN n_nationkey IN (SELECT c FROM d1) THEN 'DIRECT'
        WHEN n_nationkey IN (SELECT c FROM d2) THEN 'SECOND' ELSE 'NONE' END AS exposure, (SELECT count(*) FROM de WHERE source = n_nationkey) AS depends_on FROM nation
""")
def gra11(spark, d):
    """Components with their exposure to an origin; the shortest way counts."""
    nodes = read(spark, d, "nation").select(F.col("n_nationkey").alias("component"), F.col("n_name").alias("name"))
    return reporting.dependency_graph(nodes, dependencies(spark, d).distinct(), 4).select("component", "name", "exposure", "depends_on")


@plan("gra12_containment_graph", """
    SELECT 'R' || r_regionkey AS id, NULL AS parent, 'region' AS kind FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'nation' FROM nation
    UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'supplier' FROM supplier
""")
def gra12(spark, d):
    mark = lambda name, c: F.concat(F.lit(name), F.col(c))
    level = lambda table, own, above: read(spark, d, table).select(own.alias("id"), above.alias("parent"))
    return reporting.containment([
        ("region", level("region", mark("R", "r_regionkey"), F.lit(None))), ("nation", level("nation", mark("N", "n_nationkey"), mark("R", "n_regionkey"))),
        ("supplier", level("supplier", mark("S", "s_suppkey"), mark("N", "s_nationkey"))),
    ])
