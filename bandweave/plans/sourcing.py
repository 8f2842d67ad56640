"""Plans of sources and sinks: raw texts, payloads, fixtures, set-up lists, configuration and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prose, reporting
from ..sources import live, sinks
from .bindings import DEPENDENCIES, dependencies
from .registry import plan, read

_RAW = """
    raw AS (SELECT 0 AS place, 'supplier' AS kind, s_suppkey::VARCHAR AS ref, s_name AS text FROM supplier
        UNION ALL SELECT 1, 'customer', c_custkey::VARCHAR, c_name || ' ' || c_mktsegment FROM customer
        UNION ALL SELECT 2, 'part', p_partkey::VARCHAR, p_name || ' ' || p_brand || ' ' || p_type FROM part)
"""


def _raw(spark, d):
    keys = {"supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey"}
    return prose.raw_texts({kind: (read(spark, d, kind), key) for kind, key in keys.items()})


@plan("src27_raw_texts", f"WITH {_RAW} SELECT kind, place, ref, text FROM raw")
def src27(spark, d):
    return _raw(spark, d)


@plan("joi23_evidence_prose", f"""
    WITH {_RAW}, ev AS (SELECT row_number() OVER () AS line, l_orderkey * 10 + l_linenumber AS evidence_id, l_partkey::VARCHAR AS ref,
        CASE l_returnflag WHEN 'A' THEN 'part' WHEN 'N' THEN 'supplier' ELSE 'issue' END AS source FROM lineitem),
    r AS (SELECT evidence_id, text, row_number() OVER (PARTITION BY line ORDER BY (kind = source)::INT DESC, place) AS n FROM ev JOIN raw USING (ref))
    SELECT evidence_id, text FROM r WHERE n = 1
""")
def joi23(spark, d):
    """Line items as evidence of three kinds, one of which has no table."""
    flag = F.col("l_returnflag")
    rows = read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_partkey").cast("string").alias("ref"),
        F.when(flag == "A", "part").when(flag == "N", "supplier").otherwise("issue").alias("source"),
    )
    return prose.evidence_prose(rows, _raw(spark, d), "evidence_id")


@plan("src09_reachable_pulls", """
    WITH c AS (SELECT DISTINCT 's' || l_orderkey AS sha FROM lineitem WHERE l_linestatus = 'F'),
    p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN 's' || o_orderkey END AS merge_sha FROM orders)
    SELECT o_orderkey, merge_sha FROM p WHERE merge_sha IS NULL OR merge_sha IN (SELECT sha FROM c) OR NOT EXISTS (SELECT 1 FROM c)
""")
def src09(spark, d):
    key = F.col("o_orderkey")
    pulls = read(spark, d, "orders").select("o_orderkey", F.when(key % 7 > 0, F.concat(F.lit("s"), key)).alias("merge_sha"))
    shas = read(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.concat(F.lit("s"), "l_orderkey").alias("sha"))
    return live.reachable_pulls(pulls, shas)


def _payloads(spark, d):
    """Orders as commits, pull requests and reviews in the shape of a live interface."""
    key, when = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    author = F.struct(F.when(key % 3 > 0, F.col("o_custkey")).alias("id"))
    commit = F.struct(F.struct(F.concat(F.lit("n"), "o_custkey").alias("name"), when.alias("date")).alias("author"), F.col("o_orderpriority").alias("message"))
    files = F.transform(F.sequence(F.lit(1), (key % 3 + 1).cast("int")), lambda i: F.struct(F.when(i != 2, F.concat(F.lit("f"), i)).alias("filename")))
    merged = F.when(F.col("o_orderstatus") == "F", when)
    whole = F.struct(
        F.concat(F.lit("s"), key).alias("sha"), key.alias("id"), author.alias("author"), author.alias("user"), author.alias("assignee"), commit.alias("commit"),
        files.alias("files"), F.transform(files, lambda f: f.filename).alias("x"),
        F.transform(files, lambda f: F.struct(f.filename.alias("name"))).alias("labels"), F.struct((key % 100).alias("additions")).alias("stats"),
        merged.alias("merged_at"), F.lower("o_orderstatus").alias("state"), when.alias("created_at"), when.alias("submitted_at"),
        F.col("o_orderpriority").alias("title"), F.when(key % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("body"),
        F.struct(F.lit("main").alias("ref")).alias("base"), F.col("o_custkey").alias("pull_request_number"),
    )
    native = F.when(key % 4 == 0, F.concat(F.lit("pr-"), key, F.lit("-review-"), "o_custkey")).when(key % 4 == 1, F.concat(F.lit("pr-"), key))
    return read(spark, d, "orders").select(F.coalesce(native, F.concat(F.lit("s"), key)).alias("native_id"), F.to_json(whole).alias("payload"))


_WHO = "CASE WHEN o_orderkey % 3 > 0 AND o_custkey {0} THEN o_custkey::VARCHAR END"
_DATE = "strftime(o_orderdate, '%Y-%m-%d')"
_FILES = "array_to_string(['f1', 'f3'][1:CASE WHEN o_orderkey % 3 = 2 THEN 2 ELSE 1 END], ',')"


@plan("prj13_live_commits", f"""
    SELECT coalesce({_WHO.format('<> 0')}, 'n' || o_custkey) AS author_id, 's' || o_orderkey AS commit_id, {_DATE} AS timestamp, o_orderpriority AS message,
        {_FILES} AS files_changed, (o_orderkey % 100)::INT AS lines_added, 0 AS lines_deleted, NULL::VARCHAR AS branch FROM orders
""")
def prj13_commits(spark, d):
    return live.commits(_payloads(spark, d)).withColumn("files_changed", F.array_join("files_changed", ","))


@plan("prj13_live_issues", f"""
    SELECT {_WHO.format('>= 0')} AS author_id, o_orderkey::VARCHAR AS issue_id, {_WHO.format('>= 0')} AS assignee_id, {_DATE} AS timestamp, o_orderpriority AS title,
        CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS description, lower(o_orderstatus) AS status, {_FILES} AS labels FROM orders
""")
def prj13_issues(spark, d):
    return live.issues(_payloads(spark, d)).withColumn("labels", F.array_join("labels", ","))


@plan("prj13_live_pulls", f"""
    SELECT {_WHO.format('>= 0')} AS author_id, o_orderkey::VARCHAR AS pr_id, {_DATE} AS timestamp, o_orderpriority AS title,
        CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS description,
        CASE WHEN o_orderstatus = 'F' THEN 'MERGED' ELSE lower(o_orderstatus) END AS status, 0 AS n_files, 'main' AS target_branch FROM orders
""")
def prj13_pulls(spark, d):
    return live.pull_requests(_payloads(spark, d)).withColumn("n_files", F.size("files")).drop("files")


@plan("prj13_live_reviews", f"""
    SELECT {_WHO.format('>= 0')} AS reviewer_id, o_orderkey::VARCHAR AS review_id, o_custkey::VARCHAR AS pr_id, {_DATE} AS timestamp, lower(o_orderstatus) AS state,
        CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS comments FROM orders
""")
def prj13_reviews(spark, d):
    return live.reviews(_payloads(spark, d)).withColumn("comments", F.array_join("comments", ","))


@plan("snk02_fixture_kinds", """
    SELECT CASE o_orderkey % 4 WHEN 0 THEN 'reviews' WHEN 1 THEN 'pulls' ELSE 'commits' END AS kind, count(*) AS n FROM orders GROUP BY 1
""")
def snk02(spark, d):
    return _payloads(spark, d).groupBy(live.fixture_kind(F.col("native_id")).alias("kind")).agg(F.count("*").alias("n"))


@plan("agg30_contributors", """
    SELECT c_custkey AS id, c_name AS name, replace(lower(c_name), ' ', '.') || '@example.org' AS email, count(o_orderkey) AS records
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2
""")
def agg30_contributors(spark, d):
    """Everyone, with an address made of the name and the number of their records."""
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return reporting.contributors(people, read(spark, d, "orders").select(F.col("o_custkey").alias("id")), "example.org")


@plan("agg30_capabilities", """
    WITH e AS (SELECT l_partkey AS id, l_returnflag || ': ' || (l_orderkey * 10 + l_linenumber) AS line, l_orderkey * 10 + l_linenumber AS k FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, line) AS n FROM e),
    c AS (SELECT id, count(*) AS records, string_agg(line, ',' ORDER BY k, line) FILTER (WHERE n <= 3) AS commits FROM r GROUP BY id)
    SELECT p_partkey AS id, 'services/' || lower(p_brand) AS tag, coalesce(records, 0) AS records, CASE WHEN records > 0 THEN 'github' ELSE 'unmapped' END AS source,
        split_part(p_name, ' ', 1) AS domain, coalesce(commits, '') AS commits FROM part LEFT JOIN c ON id = p_partkey
""")
def agg30_capabilities(spark, d):
    """Every capability with the number of its records and its first three."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), k.alias("k"), F.concat("l_returnflag", F.lit(": "), k).alias("line"))
    caps = read(spark, d, "part").withColumn("id", F.col("p_partkey")).join(reporting.first_records(rows), "id", "left")
    return caps.select(
        "id", F.concat(F.lit("services/"), F.lower("p_brand")).alias("tag"), F.coalesce("records", F.lit(0)).alias("records"),
        F.when(F.col("records") > 0, "github").otherwise("unmapped").alias("source"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("domain"),
        F.coalesce("first", F.lit("")).alias("commits"),
    )


@plan("snk08_config_upsert", """
    SELECT s_name AS key, s_acctbal AS value, CAST(NULL AS VARCHAR) AS basis FROM supplier WHERE s_suppkey <> 3 UNION ALL SELECT s_name, 12.5, 'by hand' FROM supplier WHERE s_suppkey = 3
""")
def snk08(spark, d):
    config = read(spark, d, "supplier").select(F.col("s_name").alias("key"), F.col("s_acctbal").alias("value"), F.lit(None).cast("string").alias("basis"))
    return sinks.set_value(config, "Supplier#000000003", value=12.5, basis="by hand")


@plan("snk15_dependency_edit", f"WITH {DEPENDENCIES} SELECT source, target FROM de WHERE NOT (source = 4 AND target = 2) UNION SELECT 2, 17")
def snk15(spark, d):
    nodes = read(spark, d, "nation").select("n_nationkey")
    return sinks.remove_edge(sinks.add_edge(dependencies(spark, d), nodes, 2, 17), 4, 2)
