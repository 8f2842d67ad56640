"""Plans of files that are read, texts and times, drill-downs and packages. Files are written from the tables first, one a group."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import bands, drilldown, packages, scoring
from ..sources import datasets, files, mapping, relational, sinks
from ..storage import shared_dir
from .bindings import EDGES, LINE_DAY, SCORES, TOKENS, day, edges
from .registry import plan, read
from .scores import scores


def _folder(spark, name):
    return f"{shared_dir(spark)}/bandweave/{name}-{uuid.uuid4().hex}"


#: The file of an order, so that a file's size doesn't grow with the table.
_FILE = "o_orderkey div 4000"


def _arrays(rows, group, record, folder):
    """A JSON array file for each group, of the records as they are given."""
    by = rows.groupBy(group.cast("string").alias("part")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(record)), ",\n "), F.lit("]")).alias("value"))
    by.repartition("part").write.mode("append").partitionBy("part").text(folder)


def _json(**columns):
    return F.to_json(F.struct(*(c.alias(n) for n, c in columns.items())))


@plan("src01_json_arrays", "SELECT 'I' || o_orderkey AS issue_id, 'C' || o_custkey AS author_id, o_orderpriority AS status FROM orders")
def src01(spark, d):
    """Arrays of some thousand orders a file, an empty file beside them, and a source that is missing."""
    folder, o = _folder(spark, "arrays"), read(spark, d, "orders")
    record = _json(issue_id=F.concat(F.lit("I"), "o_orderkey"), author_id=F.concat(F.lit("C"), "o_custkey"), status=F.col("o_orderpriority"), unknown=F.lit(1))
    _arrays(o, F.expr(_FILE), record, folder)
    datasets._put(spark, f"{folder}/part=none/empty.txt", "")
    found = files.read_json_array(spark, f"{folder}/*/*.txt", files.RAW["issues"])
    missing = files.read_json_array(spark, f"{folder}-missing", files.RAW["issues"])
    return found.unionByName(missing).select("issue_id", "author_id", "status")


@plan("src05_file_payloads", """
    SELECT 'K-' || o_orderkey AS native_id, '{"key":"K-' || o_orderkey || '","n":' || o_custkey || '.5}' AS payload FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT 'P' || o_orderkey, '{"id":"P' || o_orderkey || '"}' FROM orders WHERE o_orderkey % 2 = 1
""")
def src05(spark, d):
    """Tickets by key and incidents by id, each payload as JSON."""
    folder, o = _folder(spark, "payloads"), read(spark, d, "orders")
    key = F.concat(F.lit('{"key":"K-'), "o_orderkey", F.lit('","n": '), "o_custkey", F.lit(".50}"))
    _arrays(o.where("o_orderkey % 2 = 0"), F.expr(_FILE), key, f"{folder}/tickets")
    _arrays(o.where("o_orderkey % 2 = 1"), F.expr(_FILE), F.concat(F.lit('{"id":"P'), "o_orderkey", F.lit('"}')), f"{folder}/incidents")
    return files.read_tickets(spark, f"{folder}/tickets").unionByName(files.read_incidents(spark, f"{folder}/incidents"))


@plan("src07_recorded_payloads", """
    SELECT 'captured' AS origin, 's' || o_orderkey AS native_id FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT 'captured', 'pr-' || o_orderkey FROM orders WHERE o_orderkey % 3 = 1
    UNION ALL SELECT 'captured', 'pr-' || o_custkey || '-review-' || o_orderkey FROM orders WHERE o_orderkey % 3 = 2
    UNION ALL SELECT 'generated', 'g' || o_orderkey FROM orders
""")
def src07(spark, d):
    """Recorded commits, pull requests and reviews; without a capture the generated ones, of which only commits are there."""
    folder, o, k = _folder(spark, "recorded"), read(spark, d, "orders"), F.col("o_orderkey")
    kinds = {
        "commits": (0, _json(sha=F.concat(F.lit("s"), k))), "pulls": (1, _json(number=k)), "reviews": (2, _json(id=k, _pr_number=F.col("o_custkey"))),
    }
    for name, (rest, record) in kinds.items():
        _arrays(o.where(k % 3 == rest), F.expr(_FILE), record, f"{folder}/captured/github_{name}.json")
    _arrays(o, F.expr(_FILE), _json(sha=F.concat(F.lit("g"), k)), f"{folder}/generated/github_commits.json")
    got = files.read_code_host(spark, f"{folder}/captured", f"{folder}/generated").withColumn("origin", F.lit("captured"))
    plain = files.read_code_host(spark, f"{folder}/none", f"{folder}/generated").withColumn("origin", F.lit("generated"))
    return got.unionByName(plain).select("origin", "native_id")


def _taxonomy(spark, d):
    folder, p = _folder(spark, "taxonomy"), read(spark, d, "part")
    brands = p.select("p_brand").distinct()
    _arrays(brands, F.lit("all"), _json(id=F.col("p_brand"), name=F.when(F.col("p_brand").endswith("1"), F.concat(F.lit("Team "), "p_brand"))), f"{folder}/capabilities.json")
    modules = p.groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("caps"), (F.min("p_size") % 3).alias("s"))
    component = F.when(F.col("p_type") > "M", F.concat(F.lit("Core "), "p_type"))
    _arrays(modules, F.lit("all"), _json(id=F.col("p_type"), name=F.col("p_type"), service_id=F.concat(F.lit("S"), "s"), capability_ids=F.col("caps"), jira_component=component), f"{folder}/modules.json")
    _arrays(spark.range(3), F.lit("all"), _json(id=F.concat(F.lit("S"), "id")), f"{folder}/services.json")
    return folder


@plan("src03_taxonomy_files", """
    SELECT p_type AS module_id, 'S' || min(p_size) % 3 AS service, string_agg(DISTINCT CASE WHEN p_brand LIKE '%1' THEN 'Team ' || p_brand ELSE p_brand END, ','
        ORDER BY CASE WHEN p_brand LIKE '%1' THEN 'Team ' || p_brand ELSE p_brand END) AS capabilities FROM part GROUP BY 1
""")
def src03(spark, d):
    """Three files that refer to each other; names that are missing are the ids."""
    found = files.read_taxonomy(spark, _taxonomy(spark, d))
    named = found["modules"].select("id", "service_id", F.explode("capability_ids").alias("c")).join(found["capabilities"].select(F.col("id").alias("c"), "name"), "c")
    by = named.groupBy("id", "service_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("capabilities"))
    service = found["services"].select(F.col("id").alias("service_id"), F.col("name").alias("service"))
    return by.join(service, "service_id").select(F.col("id").alias("module_id"), "service", "capabilities")


@plan("src26_component_slugs", """
    SELECT p_type AS module_id, CASE WHEN p_type > 'M' THEN 'core-' ELSE '' END || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
        trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS bare FROM part GROUP BY 1
""")
def src26(spark, d):
    """With the optional file of modules, and without."""
    folder = _taxonomy(spark, d)
    modules = files.read_taxonomy(spark, folder)["modules"].select("id", "name")
    bare = files.component_slugs(spark, f"{folder}/missing.json", modules).withColumnRenamed("slug", "bare")
    return files.component_slugs(spark, f"{folder}/modules.json", modules).join(bare, "module_id")


@plan("src25_mapping_files", "SELECT n_name AS space_key, 'S' || n_regionkey AS service_id, 'auto' AS status, n_nationkey::DOUBLE AS score FROM nation WHERE n_nationkey % 4 > 0")
def src25(spark, d):
    """A mapping file a nation; every fourth is cut short, and one is missing."""
    n, folder = read(spark, d, "nation"), _folder(spark, "mapping")
    entry = F.struct(F.concat(F.lit("S"), "n_regionkey").alias("service_id"), F.lit("auto").alias("status"), F.col("n_nationkey").cast("double").alias("score"))
    whole = F.to_json(F.struct(F.create_map(F.col("n_name"), entry).alias("spaces")))
    value = F.when(F.col("n_nationkey") % 4 == 0, F.expr("'not json {'")).otherwise(whole)
    n.select(F.col("n_nationkey").alias("part"), value.alias("value")).repartition("part").write.partitionBy("part").text(folder)
    found = mapping.load(spark, folder).unionByName(mapping.load(spark, f"{folder}-missing"))
    return found.select("space_key", "service_id", "status", "score")


@plan("snk09_manual_mapping", """
    SELECT n_name AS space_key, CASE WHEN n_name = (SELECT min(n_name) FROM nation) THEN NULL ELSE 'S' || n_regionkey END AS service_id,
        CASE WHEN n_name = (SELECT min(n_name) FROM nation) THEN 'manual' ELSE 'auto' END AS status, n_nationkey::DOUBLE AS score FROM nation
    UNION ALL SELECT 'NEW SPACE', 'S9', 'manual', 0.0
""")
def snk09(spark, d):
    """Saved, read, two decisions by hand, one on a space that wasn't known, saved and read again."""
    n, path, empty = read(spark, d, "nation"), _folder(spark, "mapping"), F.array().cast("array<string>")
    mapping.save(n.select(
        F.col("n_name").alias("space_key"), F.lower("n_name").alias("space_name"), F.concat(F.lit("S"), "n_regionkey").alias("service_id"), F.lit("auto").alias("status"),
        F.col("n_nationkey").cast("double").alias("score"), empty.alias("reasons"), empty.alias("candidates")), path)
    first = n.agg(F.min("n_name")).first()[0]
    for key, service in ((first, None), ("NEW SPACE", "S9")):
        mapping.save(mapping.set_manual(mapping.load(spark, path), key, service), path)
    return mapping.load(spark, path).select("space_key", "service_id", "status", "score")


@plan("snk05_three_outputs", f"""
    WITH {SCORES}, s AS (SELECT employee_id, count(*) AS skills FROM sc GROUP BY 1)
    SELECT 'evidence' AS output, employee_id, count(*) AS n FROM con GROUP BY 2 UNION ALL SELECT 'summary', employee_id, skills FROM s UNION ALL SELECT 'detail', employee_id, skills FROM s
""")
def snk05(spark, d):
    """Evidence, summary and detail written as JSON and read back."""
    from .scores import contributions

    folder, found = _folder(spark, "outputs"), scores(spark, d)
    sinks.write_outputs({"evidence": contributions(spark, d), "summary": scoring.summary(found), "detail": found}, folder)
    back = {name: datasets.read(spark, f"{folder}/{name}", "json") for name in ("evidence", "summary", "detail")}
    n = {"evidence": F.count("*"), "summary": F.sum(F.size("skills")), "detail": F.count("*")}
    each = [df.groupBy("employee_id").agg(n[name].cast("long").alias("n")).select(F.lit(name).alias("output"), "employee_id", "n") for name, df in back.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


_CORE = "['api','endpoint','middleware','gateway','webhook','auth','routing'], ['reconciliation','reconcile','settlement','transaction','matching','currency','ledger']"


@plan("str03_keyword_overrides", f"""
    WITH c AS (SELECT DISTINCT 'C00' || (1 + p_size % 2) AS id, p_type AS name FROM part WHERE p_size % 5 < 2
               UNION SELECT p_brand, p_type FROM part)
    SELECT id AS capability_id, name, array_to_string(list_sort(list_distinct(list_concat({TOKENS.format("name || ' gateway tools'")},
        CASE id WHEN 'C001' THEN {_CORE.split('], ')[0]}] WHEN 'C002' THEN {_CORE.split('], ')[1]} ELSE [] END))), ',') AS keywords FROM c
""")
def str03(spark, d):
    """Capabilities with curated keywords beside such without."""
    p = read(spark, d, "part")
    curated = p.where("p_size % 5 < 2").select(F.concat(F.lit("C00"), 1 + F.col("p_size") % 2).alias("id"), F.col("p_type").alias("name"))
    caps = curated.unionByName(p.select(F.col("p_brand").alias("id"), F.col("p_type").alias("name"))).distinct()
    found = scoring.taxonomy(caps.withColumn("description", F.lit("gateway tools")))
    return found.select("capability_id", F.col("capability_name").alias("name"), F.array_join(F.array_sort("keywords"), ",").alias("keywords"))


@plan("str11_signatures", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'dir:src,dir:src/' || event_type WHEN event_id % 3 = 1 THEN 'label:' || event_type || ',service:x' ELSE '' END AS signature FROM events
""")
def str11(spark, d):
    k, t = F.col("event_id") % 3, F.col("event_type")
    tokens = F.when(k == 0, F.array(F.lit("dir:src"), F.concat(F.lit("dir:src/"), t), F.lit("label:a"), F.lit("path:x"))).when(
        k == 1, F.array(F.concat(F.lit("label:"), t), F.lit("path:x"), F.lit("service:x"))).otherwise(F.array(F.lit("path:x"), F.lit("unclassified")))
    return read(spark, d, "events").select("event_id", F.array_join(text.signature(tokens), ",").alias("signature"))


@plan("str20_package_slugs", """
    SELECT o_orderkey, 'transfer-package-' || regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]+', '_', 'g') || '-C' || o_custkey || '-' || strftime(CAST(o_orderdate AS TIMESTAMP), '%Y%m%d-%H%M%S') AS slug FROM orders
""")
def str20(spark, d):
    who = F.array(F.col("o_orderpriority"), F.concat(F.lit("C"), "o_custkey"))
    return read(spark, d, "orders").select("o_orderkey", packages.slug(who, F.col("o_orderdate").cast("timestamp")).alias("slug"))


@plan("dat03_iso_times", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN make_timestamp(2024, 1, 1 + event_id % 28, 10, 30, 0.0) WHEN 1 THEN make_timestamp(2024, 1, 1 + event_id % 28, 8, 30, 0.0)
        WHEN 2 THEN make_timestamp(2024, 1, 1 + event_id % 28, 0, 0, 0.0) END AS at,
        coalesce(CASE event_id % 4 WHEN 0 THEN make_timestamp(2024, 1, 1 + event_id % 28, 10, 30, 0.0) WHEN 1 THEN make_timestamp(2024, 1, 1 + event_id % 28, 8, 30, 0.0)
        WHEN 2 THEN make_timestamp(2024, 1, 1 + event_id % 28, 0, 0, 0.0) END, TIMESTAMP '2024-02-01 00:00:00') AS dated FROM events
""")
def dat03(spark, d):
    """With Z, with an offset, a day alone, and what is no time: null, or the time that stands for now."""
    k, n = F.col("event_id") % 4, F.lpad((1 + F.col("event_id") % 28).cast("string"), 2, "0")
    raw = F.concat(F.lit("2024-01-"), n, F.when(k == 0, "T10:30:00Z").when(k == 1, "T10:30:00+02:00").when(k == 2, "").otherwise("T25:00 or so"))
    now = F.lit("2024-02-01").cast("timestamp")
    plain = lambda c: c.cast("timestamp_ntz")
    return read(spark, d, "events").select("event_id", plain(dates.parse_timestamp(raw)).alias("at"), plain(dates.parse_timestamp(raw, now)).alias("dated"))


@plan("win03_first_and_last", """
    SELECT l_suppkey AS employee_id, min(CASE WHEN l_linenumber < 6 THEN CAST(l_shipdate AS DATE) END) AS first_day, max(CASE WHEN l_linenumber < 6 THEN CAST(l_shipdate AS DATE) END) AS last_day,
        count(*) FILTER (WHERE l_linenumber >= 6) AS undated, count(*) - count(*) FILTER (WHERE l_linenumber >= 6) AS undated_from FROM lineitem GROUP BY 1
""")
def win03(spark, d):
    """Undated evidence counts, stands last and is neither first nor last."""
    rows = read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("employee_id"), F.lit("C").alias("capability_id"), F.when(F.col("l_linenumber") < 6, F.col("l_shipdate").cast("date")).alias("day"),
        F.col("l_orderkey").alias("evidence_id"), F.lit(0.1).alias("contribution"))
    found = scoring.employee_skills(rows)
    undated = F.filter("timeline", lambda t: t["day"].isNull())
    at = F.array_position(F.transform("timeline", lambda t: t["day"].isNull()), True) - 1
    return found.select("employee_id", F.col("first_demonstrated").alias("first_day"), F.col("last_demonstrated").alias("last_day"), F.size(undated).cast("long").alias("undated"),
                        F.when(at >= 0, at).otherwise(F.col("evidence_count")).alias("undated_from"))


@plan("srt01_results_in_order", f"""
    WITH {SCORES} SELECT employee_id, capability_id, row_number() OVER (PARTITION BY employee_id ORDER BY CASE WHEN capability_id LIKE '%1' THEN '' ELSE lower(capability_id) END, capability_id) AS place FROM sc
""")
def srt01(spark, d):
    """An employee's skills by name; those without a name first."""
    name = F.when(~F.col("capability_id").endswith("1"), F.lower("capability_id"))
    return scoring.in_order(scores(spark, d).withColumn("skill_name", name)).select("employee_id", "capability_id", "place")


@plan("srt11_links_in_order", """
    SELECT c_custkey AS page_id, m AS capability_id, row_number() OVER (PARTITION BY c_custkey ORDER BY c DESC, m) AS place
    FROM (SELECT c_custkey, unnest([c_mktsegment, 'SPACE', 'ABOVE']) AS m, unnest([1.0, 0.6, CASE WHEN c_custkey % 2 = 0 THEN 0.6 ELSE 0.8 END]) AS c FROM customer)
""")
def srt11(spark, d):
    """A page's links, the surest first, equal ones by capability."""
    from ..operators import retrieval

    link = lambda name, c: F.struct(name.alias("capability_id"), c.alias("confidence"))
    sure = F.when(F.col("c_custkey") % 2 == 0, 0.6).otherwise(0.8)
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.explode(F.array(
        link(F.col("c_mktsegment"), F.lit(1.0)), link(F.lit("SPACE"), F.lit(0.6)), link(F.lit("ABOVE"), sure))).alias("l"))
    return retrieval.links_in_order(rows.select("page_id", "l.*")).select("page_id", "capability_id", "place")


@plan("qry07_evidence_drilldown", f"""
    WITH {EDGES}, i AS (SELECT person, count(DISTINCT unit) AS unit_count, string_agg(item_id || ' ' || CASE age_cap WHEN 3 THEN 'fresh' WHEN 2 THEN 'aging' ELSE 'stale' END || ' ' || ceiling, ','
        ORDER BY occurred_at DESC, item_id, CASE age_cap WHEN 3 THEN 'fresh' WHEN 2 THEN 'aging' ELSE 'stale' END, ceiling) AS items FROM cl WHERE capability = 'Brand#12' GROUP BY person)
    SELECT person, band_code, person = 3 AS removed, unit_count, items FROM i JOIN bd USING (person) WHERE capability = 'Brand#12'
""")
def qry07(spark, d):
    capped = bands.ceilings(edges(spark, d), day(LINE_DAY), F.lit(5), F.lit(7), F.lit(5.0))
    found = drilldown.evidence(capped, bands.assign(capped, day(LINE_DAY)), "Brand#12", day(LINE_DAY), removed=3)
    shown = F.array_sort(F.transform("items", lambda i: F.struct(i["order"].alias("o"), i["item_id"].alias("i"), i["age"].alias("a"), i["ceiling"].alias("c"))))
    line = F.array_join(F.transform(shown, lambda i: F.concat_ws(" ", i["i"].cast("string"), i["a"], i["c"].cast("string"))), ",")
    return found.select("person", "band_code", "removed", "unit_count", line.alias("items"))


@plan("qry07_excluded_items", """
    WITH i AS (SELECT event_id AS item_id, user_id, event_type, value > 30 AS eligible FROM events),
    t AS (SELECT DISTINCT event_type FROM i WHERE eligible AND user_id % 7 = 3)
    SELECT item_id, 'low value' AS exclusion_reason FROM i WHERE NOT eligible AND event_type IN (SELECT event_type FROM t) ORDER BY item_id LIMIT 25
""")
def qry07_excluded(spark, d):
    e = read(spark, d, "events")
    good = F.col("value") > 30
    items = e.select(F.col("event_id").alias("item_id"), good.alias("eligible"), F.when(~good, "low value").alias("exclusion_reason"), F.array(F.concat(F.lit("label:"), "event_type"), F.lit("path:same")).alias("tokens"))
    return drilldown.excluded(items, e.where("user_id % 7 = 3").select(F.col("event_id").alias("item_id")))


@plan("qry12_raw_record", "SELECT event_id AS record_id, event_type AS source, props AS payload FROM events WHERE event_id = (SELECT max(event_id) FROM events)")
def qry12(spark, d):
    e = read(spark, d, "events")
    rows = e.select(F.col("event_id").alias("record_id"), F.col("event_type").alias("source"), F.col("props").alias("payload"))
    return drilldown.record(rows, e.agg(F.max("event_id")).first()[0])


_PACKAGES = """
    g AS (SELECT n_regionkey AS r, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS no FROM nation WHERE n_regionkey > 0),
    l AS (SELECT r, string_agg('| ' || n_name || ' (' || n_nationkey || ') | HIGH | **LOW** | 0.25 | ' || CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 END || ' |', chr(10) ORDER BY no) AS rows,
        string_agg('## ' || n_name || chr(10) || chr(10) || '**LOW** — coverage fell from HIGH (0.80) to LOW (0.25).' || CASE WHEN n_nationkey % 2 = 0 THEN ' Strongest remaining: Bo.' ELSE ' No remaining coverage.' END
            || chr(10) || chr(10) || '### Supporting Documentation' || chr(10) || chr(10)
            || CASE WHEN n_nationkey % 3 = 0 THEN '_No documentation matched this capability._' ELSE '#### 1. [Guide ' || n_nationkey || '](http://x/' || n_nationkey || ')' END || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY no) AS sections,
        string_agg(n_name, ', ' ORDER BY no) FILTER (WHERE n_nationkey % 3 = 0) AS bare, count(*) AS n FROM g GROUP BY r)
"""


@plan("snk11_markdown_packages", f"""
    WITH {_PACKAGES}, h AS (SELECT r_regionkey AS k, '# Knowledge Transfer Package' || chr(10) || chr(10) || '**Absence simulated:** ' || r_name || chr(10) || chr(10)
        || '**Generated:** 2024-02-01 00:00 UTC' || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS head, r_name FROM region)
    SELECT 'transfer-package-R' || k || '-20240201-000000' AS slug, head || CASE WHEN n IS NULL
        THEN 'All 25 capabilities keep MODERATE or better coverage after this absence. No knowledge transfer is required.'
        ELSE n || ' of 25 capabilities fall to LOW or NONE without ' || r_name || '. The documentation for each one follows.' || chr(10) || chr(10)
            || coalesce('> **No documentation exists for: ' || bare || '.**' || chr(10) || chr(10), '')
            || '### Capabilities Requiring Transfer' || chr(10) || chr(10) || '| Capability | Before | After | Score | Documents |' || chr(10) || '|---|---|---|---|---|' || chr(10)
            || rows || chr(10) || chr(10) || '---' || chr(10) || chr(10) || rtrim(sections, chr(10)) END || chr(10) AS markdown FROM h LEFT JOIN l ON r = k
""")
def snk11(spark, d):
    """A package a region, written and read back; the first has no gaps."""
    n, folder = read(spark, d, "nation"), _folder(spark, "packages")
    made = read(spark, d, "region").select(
        F.col("r_regionkey").alias("package_id"), F.array(F.concat(F.lit("R"), "r_regionkey")).alias("absent_ids"), F.array("r_name").alias("absent_names"),
        F.lit("2024-02-01").cast("timestamp").alias("generated_at"), F.lit(25).alias("total"))
    k = F.col("n_nationkey")
    document = F.struct(F.concat(F.lit("Guide "), k).alias("title"), F.concat(F.lit("http://x/"), k).alias("url"))
    none = F.array().cast("array<struct<title: string, url: string>>")
    gaps = n.where("n_regionkey > 0").select(
        F.col("n_regionkey").alias("package_id"), k.alias("gap_no"), k.cast("string").alias("capability_id"), F.col("n_name").alias("capability"), F.lit("HIGH").alias("band_before"),
        F.lit("LOW").alias("band_after"), F.lit(0.8).alias("score_before"), F.lit(0.25).alias("score_after"), F.when(k % 2 == 0, "Bo").alias("strongest"),
        F.when(k % 3 == 0, none).otherwise(F.array(document)).alias("documents"))
    packages.write(packages.render_markdown(made, gaps), folder)
    return spark.read.text(folder, wholetext=True).select("slug", F.col("value").alias("markdown"))


@plan("srt10_packages_newest_first", "SELECT 'transfer-package-' || r_name || '-x' AS slug, row_number() OVER (ORDER BY r_regionkey DESC) AS place FROM region")
def srt10(spark, d):
    """Packages written one after the other."""
    import time

    folder, r = _folder(spark, "packages"), read(spark, d, "region")
    for k in [x.r_regionkey for x in r.select("r_regionkey").orderBy("r_regionkey").collect()]:  # a region each
        one = r.where(F.col("r_regionkey") == k).select(F.concat(F.lit("transfer-package-"), "r_name", F.lit("-x")).alias("slug"), F.lit("# x").alias("markdown"))
        packages.write(one, folder)
        time.sleep(0.02)  # file times are in milliseconds
    return packages.written(spark, folder).select("slug", "place")


def _relational(spark, d):
    p = read(spark, d, "part")
    caps = p.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("capability_id"), F.min("p_type").alias("component_id")).withColumn("description", F.lit(None).cast("string"))
    components = p.select(F.col("p_type").alias("component_id"), (F.length("p_type") % 2).alias("system_id"), F.col("p_type").alias("name"), F.lit(None).cast("string").alias("description")).distinct()
    systems = spark.range(2).select(F.col("id").alias("system_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"))
    return systems, components, caps


@plan("src30_relational_taxonomy", """
    WITH c AS (SELECT min(p_partkey) AS id, min(p_type) AS t FROM part GROUP BY p_brand)
    SELECT p_type AS module_id, (length(p_type) % 2)::VARCHAR AS service, coalesce((SELECT string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) FROM c WHERE t = p_type), '') AS capabilities
    FROM (SELECT DISTINCT p_type FROM part)
""")
def src30_taxonomy(spark, d):
    found = relational.taxonomy(*_relational(spark, d))
    service = found["services"].select(F.col("id").alias("service_id"), F.col("name").alias("service"))
    return found["modules"].join(service, "service_id").select(F.col("id").alias("module_id"), "service", F.array_join("capability_ids", ",").alias("capabilities"))


@plan("src30_relational_evidence", """
    WITH c AS (SELECT p_brand, min(p_partkey) AS id, min(p_type) AS t FROM part GROUP BY p_brand)
    SELECT l_suppkey::VARCHAR AS employee_id, id::VARCHAR AS capability_id, t AS module_id, lower(l_returnflag) AS type, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date,
        count(*) AS n, sum(CASE WHEN l_discount = 0 THEN 1.0 ELSE l_discount END) AS score
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN c USING (p_brand) GROUP BY ALL
""")
def src30_evidence(spark, d):
    """Line items as evidence of brands; a discount of zero counts as full strength."""
    caps = _relational(spark, d)[2]
    brands = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name")).join(caps.select("name", "capability_id"), "name")
    rows = read(spark, d, "lineitem").join(brands, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), F.col("l_suppkey").alias("employee_id"), "capability_id", F.col("l_returnflag").alias("evidence_type"),
        F.col("l_shipdate").alias("observed_at"), F.col("l_discount").alias("strength"), F.lit(None).cast("string").alias("description"))
    found = relational.evidence(rows, caps)
    return found.groupBy("employee_id", "capability_id", "module_id", "type", "date").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
