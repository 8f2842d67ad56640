"""Plans of ordinal bands, coverage, graphs, clusters and teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bands, graph, reporting, similarity, teams
from .bindings import DEPENDENCIES, EDGES, LINE_DAY, TOKENS, day, dependencies, edges, edges_sql, signatures
from .registry import plan, read


def _ceilings(spark, d):
    return bands.ceilings(edges(spark, d), day(LINE_DAY), F.lit(5), F.lit(7), F.lit(5.0))


def _bands(spark, d):
    return bands.assign(_ceilings(spark, d), day(LINE_DAY))


@plan("agg05_ceilings", f"""
    WITH {EDGES} SELECT ceiling, CASE WHEN age_cap = ceiling THEN 'age' WHEN breadth_cap = ceiling THEN 'breadth'
        WHEN certainty_cap = ceiling THEN 'certainty' WHEN role_cap = ceiling THEN 'role' ELSE 'substance' END AS binding_cap, count(*) AS n
    FROM cl GROUP BY 1, 2
""")
def agg05(spark, d):
    return _ceilings(spark, d).groupBy("ceiling", "binding_cap").agg(F.count("*").alias("n"))


@plan("agg07_assign_bands", f"WITH {EDGES} SELECT person, capability, band_code FROM bd")
def agg07(spark, d):
    return _bands(spark, d).select("person", "capability", "band_code")


@plan("agg08_dominance", f"WITH {edges_sql(capability='p_partkey')} SELECT person, capability FROM dom")
def agg08(spark, d):
    """Single parts as capabilities: of these some people have more fresh authored units than all others together."""
    found = bands.ceilings(edges(spark, d, "p_partkey"), day(LINE_DAY), F.lit(5), F.lit(7), F.lit(5.0))
    return bands.assign(found, day(LINE_DAY)).where("dominant").select("person", "capability")


@plan("agg09_unit_breadth", "SELECT l_orderkey AS unit, count(DISTINCT p_brand) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def agg09(spark, d):
    return reporting.unit_breadth(edges(spark, d))


@plan("joi19_band_grid", f"""
    WITH {EDGES} SELECT s_suppkey AS person, p.capability, coalesce(band_code, 0) AS band_code
    FROM supplier CROSS JOIN (SELECT DISTINCT p_brand AS capability FROM part) p
    LEFT JOIN bd ON bd.person = s_suppkey AND bd.capability = p.capability
""")
def joi19(spark, d):
    people = read(spark, d, "supplier").select(F.col("s_suppkey").alias("person"))
    caps = read(spark, d, "part").select(F.col("p_brand").alias("capability")).distinct()
    return bands.grid(people, caps, _bands(spark, d)).select("person", "capability", "band_code")


@plan("agg10_coverage", f"""
    WITH {EDGES}, t AS (SELECT capability, count(*) FILTER (WHERE band_code >= 2) AS n_coverers, max(band_code) AS best_band,
        string_agg(person, ',' ORDER BY person) FILTER (WHERE band_code >= 2) AS coverers FROM bd GROUP BY capability)
    SELECT t.*, (SELECT min(person) FROM bd WHERE bd.capability = t.capability AND band_code = best_band) AS best_holder FROM t
""")
def agg10(spark, d):
    names = F.nullif(F.array_join(F.transform("coverers", lambda p: p.cast("string")), ","), F.lit(""))
    return bands.coverage(_bands(spark, d)).select("capability", "n_coverers", "best_band", names.alias("coverers"), "best_holder")


@plan("qry05_at_risk", f"""
    WITH {EDGES}, t AS (SELECT capability, count(*) FILTER (WHERE band_code = 3) AS n_coverers FROM bd GROUP BY capability)
    SELECT capability, n_coverers, CASE WHEN n_coverers = 0 THEN 'uncovered' ELSE 'single' END AS risk FROM t WHERE n_coverers <= 1
""")
def qry05(spark, d):
    return bands.at_risk(bands.coverage(_bands(spark, d), 3)).select("capability", "n_coverers", "risk")


@plan("qry06_simulate_absence", f"""
    WITH {EDGES}, t AS (SELECT capability, count(*) FILTER (WHERE band_code >= 2) AS before, count(*) FILTER (WHERE band_code >= 2 AND person <> 3) AS after,
        max(band_code) AS best_before, coalesce(max(band_code) FILTER (WHERE person <> 3), 0) AS best_after FROM bd GROUP BY capability)
    SELECT *, CASE WHEN before = 0 AND after = 0 THEN 'Uncovered' WHEN before > 0 AND after = 0 THEN 'Lost'
        WHEN after < before OR best_after < best_before THEN 'Degraded' ELSE 'Maintained' END AS status FROM t
""")
def qry06(spark, d):
    return bands.absence(_bands(spark, d), 3)


@plan("agg12_activity", f"""
    WITH {EDGES} SELECT capability, bool_or(date_diff('day', unit_at, DATE '2001-11-05') / 30.44 <= 12) AS active,
        count(DISTINCT unit) < 300 AS is_thin FROM e JOIN br USING (unit) GROUP BY capability
""")
def agg12(spark, d):
    return bands.activity(edges(spark, d), day(LINE_DAY), 300)


@plan("agg14_nearest_rank", """
    WITH s AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r,
                      count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    SELECT l_suppkey, max(l_quantity) FILTER (WHERE r = round_even(0.1 * (n - 1), 0) + 1) AS p10,
           max(l_quantity) FILTER (WHERE r = round_even(0.9 * (n - 1), 0) + 1) AS p90 FROM s GROUP BY l_suppkey
""")
def agg14(spark, d):
    return similarity.nearest_ranks(read(spark, d, "lineitem"), ("l_suppkey",), "l_quantity", p10=0.1, p90=0.9)


@plan("gra07_exposure", f"""
    WITH {DEPENDENCIES}, d1 AS (SELECT DISTINCT source AS c FROM de WHERE target = 4 AND source <> 4),
    d2 AS (SELECT DISTINCT source AS c FROM de WHERE target IN (SELECT c FROM d1) AND source <> 4 AND source NOT IN (SELECT c FROM d1))
    SELECT c AS component, 1 AS hop FROM d1 UNION ALL SELECT c, 2 FROM d2
""")
def gra07(spark, d):
    start = read(spark, d, "nation").where("n_nationkey = 4").select(F.col("n_nationkey").alias("component"))
    return graph.exposure(start, dependencies(spark, d).distinct())


@plan("gra08_blast_radius", f"""
    WITH RECURSIVE {DEPENDENCIES}, r(c, h) AS (SELECT 4, 0 UNION SELECT de.source, r.h + 1 FROM r JOIN de ON de.target = r.c WHERE r.h < 25)
    SELECT c AS component, min(h) AS hop FROM r GROUP BY c
""")
def gra08(spark, d):
    nodes = read(spark, d, "nation").select(F.col("n_nationkey").alias("component"))
    return graph.blast_radius(4, nodes, dependencies(spark, d).distinct())


def _tree(spark, d):
    """Regions above nations above customers."""
    region = read(spark, d, "region").select((F.col("r_regionkey") - 1000).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("parent"), F.lit(True).alias("is_start"))
    nation = read(spark, d, "nation").select((F.col("n_nationkey") - 500).cast("bigint").alias("node"), (F.col("n_regionkey") - 1000).cast("bigint").alias("parent"), F.lit(True).alias("is_start"))
    customer = read(spark, d, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") - 500).cast("bigint").alias("parent"), F.lit(False).alias("is_start"))
    return region.unionByName(nation).unionByName(customer)


_TREE = """
    tr(node, parent, is_start) AS (
        SELECT r_regionkey::BIGINT - 1000, NULL::BIGINT, true FROM region UNION ALL SELECT n_nationkey::BIGINT - 500, n_regionkey::BIGINT - 1000, true FROM nation
        UNION ALL SELECT c_custkey, c_nationkey::BIGINT - 500, false FROM customer
    ),
    cl(ancestor, node, hops) AS (
        SELECT node, node, 0 FROM tr WHERE is_start UNION ALL SELECT cl.ancestor, tr.node, hops + 1 FROM cl JOIN tr ON tr.parent = cl.node
    )
"""


@plan("gra04_closure", f"WITH RECURSIVE {_TREE} SELECT ancestor, node, hops FROM cl")
def gra04(spark, d):
    return graph.closure(_tree(spark, d), depth=5)


@plan("gra05_members", f"""
    WITH RECURSIVE {_TREE} SELECT cl.ancestor, count(DISTINCT o_orderkey) AS n FROM cl LEFT JOIN orders ON o_custkey = cl.node GROUP BY 1
""")
def gra05(spark, d):
    orders = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("k"))
    below = graph.closure(_tree(spark, d), depth=5).join(orders, "node", "left")
    return below.groupBy("ancestor").agg(F.sum(F.coalesce("k", F.lit(0))).alias("n"))


@plan("gra06_nested_starts", "SELECT n_regionkey::BIGINT - 1000 AS ancestor, n_nationkey::BIGINT - 500 AS node FROM nation")
def gra06(spark, d):
    return graph.cycle_violations(_tree(spark, d))


@plan("gra09_ancestors", """
    SELECT c_custkey AS page, 1 AS hops, 'N' || c_nationkey AS title FROM customer
    UNION ALL SELECT c_custkey, 2, 'R' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT n_nationkey::BIGINT - 500, 1, 'R' || n_regionkey FROM nation
""")
def gra09(spark, d):
    n = F.col("node")
    title = F.when(n < -900, F.concat(F.lit("R"), n + 1000)).when(n < 0, F.concat(F.lit("N"), n + 500)).otherwise(F.concat(F.lit("C"), n))
    return graph.ancestors(_tree(spark, d).select(n.alias("page"), "parent", title.alias("title")))


@plan("gra02_work_units", """
    WITH RECURSIVE k AS (SELECT DISTINCT user_id AS item, regexp_extract(props, '\\d+', 0)::INT // 10 AS key FROM events),
    kk AS (SELECT DISTINCT a.key AS x, b.key AS y FROM k a JOIN k b USING (item)),
    r(x, y) AS (SELECT x, y FROM kk UNION SELECT r.x, kk.y FROM r JOIN kk ON kk.x = r.y),
    c AS (SELECT r.x AS key, min(item) AS component FROM r JOIN k ON k.key = r.y GROUP BY 1)
    SELECT item AS node, min(component) AS component FROM k JOIN c USING (key) GROUP BY item
""")
def gra02(spark, d):
    key = F.floor(F.regexp_extract("props", r"\d+", 0).cast("int") / 10)
    items = read(spark, d, "events").select(F.col("user_id").alias("item_id"), key.alias("key")).distinct()
    return graph.components(items.select(F.col("item_id").alias("node")), graph.shared_keys(items))


@plan("agg16_unit_rollup", """
    SELECT c_nationkey AS unit, max(o_orderdate) AS occurred_at, count(*) AS members FROM (
        SELECT c_custkey, c_nationkey, max(o_orderdate) AS o_orderdate FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1
""")
def agg16(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    items = rows.select(F.col("c_custkey").alias("item_id"), F.concat(F.lit("N-"), F.col("c_nationkey")).alias("key"), F.col("o_orderdate").alias("occurred_at"))
    names = read(spark, d, "customer").select(F.col("c_custkey").alias("unit"), "c_nationkey")
    return similarity.work_units(items).join(names, "unit").select(F.col("c_nationkey").alias("unit"), "occurred_at", "members")


_SIG = f"""
    it AS (SELECT p_partkey AS item, list_sort({TOKENS.format("concat_ws(' ', p_name, p_brand, lower(p_type))")}) AS s FROM part),
    sg AS (SELECT s, min(item) AS rep FROM it WHERE len(s) > 0 GROUP BY s),
    pr AS (SELECT a.rep AS a, b.rep AS b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM sg a JOIN sg b ON a.rep < b.rep)
"""


@plan("joi09_similar_signatures", f"WITH {_SIG} SELECT a, b, round_even(j, 6) AS similarity FROM pr WHERE j >= 0.6")
def joi09(spark, d):
    items = signatures(spark, d)
    sig = F.array_join(F.array_sort("signature"), "\x1f")
    first = items.where(F.size("signature") > 0).groupBy(sig.alias("k")).agg(F.min("item_id").alias("rep"))
    found = similarity.similar_signatures(items, 0.6).select(F.array_join("a", "\x1f").alias("ka"), F.array_join("b", "\x1f").alias("kb"), "similarity")
    both = found.join(first.toDF("ka", "ra"), "ka").join(first.toDF("kb", "rb"), "kb")
    return both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), F.bround("similarity", 6).alias("similarity"))


@plan("gra01_clusters", f"""
    WITH RECURSIVE {_SIG}, e AS (SELECT a, b FROM pr WHERE j >= 0.8 UNION ALL SELECT b, a FROM pr WHERE j >= 0.8),
    r(n, m) AS (SELECT rep, rep FROM sg UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m),
    c AS (SELECT n, min(m) AS c FROM r GROUP BY n)
    SELECT it.item AS item_id, c.c AS cluster FROM it JOIN sg ON it.s = sg.s JOIN c ON c.n = sg.rep
""")
def gra01(spark, d):
    return similarity.clusters(signatures(spark, d), 0.8)


@plan("agg17_common_signature", f"""
    WITH it AS (SELECT p_type AS cluster, p_partkey AS item, unnest({TOKENS.format("concat_ws(' ', p_name, p_brand, lower(p_type))")}) AS t FROM part),
    z AS (SELECT p_type AS cluster, count(*) AS n FROM part GROUP BY 1)
    SELECT cluster, string_agg(t, ',' ORDER BY t) AS common FROM (
        SELECT it.cluster, t FROM it JOIN z USING (cluster) GROUP BY it.cluster, t, z.n HAVING count(DISTINCT item) = z.n) GROUP BY cluster
""")
def agg17(spark, d):
    kinds = read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("cluster"))
    members = signatures(spark, d).join(kinds, "item_id")
    return similarity.common_signature(members).select("cluster", F.array_join("common", ",").alias("common"))


@plan("joi12_best_summary", """
    WITH c AS (SELECT label AS node_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
    s AS (SELECT vec_id AS item_id, node_id, list_cosine_similarity(embedding::DOUBLE[], v) AS s FROM embeddings CROSS JOIN c),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, node_id) AS n FROM s)
    SELECT item_id, node_id, round_even(s, 6) AS similarity FROM r WHERE n = 1 AND s >= 0.25
""")
def joi12(spark, d):
    e = read(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").alias("node_id"), "vector")
    found = similarity.best_match(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), first)
    return found.select("item_id", "node_id", F.bround("similarity", 6).alias("similarity"))


@plan("opt06_qualifications", f"WITH {EDGES} SELECT person, capability, band_code >= 2 AS qualified FROM bd")
def opt06(spark, d):
    return teams.qualifications(_bands(spark, d), 2).select("person", "capability", "qualified")


@plan("opt07_closest_candidates", f"""
    WITH {EDGES}, o AS (SELECT capability FROM bd GROUP BY capability HAVING max(band_code) < 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY band_code DESC, person) AS n FROM bd WHERE band_code > 0 AND capability IN (SELECT capability FROM o))
    SELECT capability, person, band_code FROM r WHERE n = 1
""")
def opt07(spark, d):
    found = _bands(spark, d)
    uncovered = bands.coverage(found, 3).where("n_coverers = 0")
    return teams.closest_candidates(found, uncovered)


@plan("mth12_band_counts", f"WITH {EDGES} SELECT CASE band_code WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MODERATE' WHEN 1 THEN 'LOW' ELSE 'NONE' END AS band, count(*) AS n FROM bd GROUP BY 1")
def mth12(spark, d):
    from ..functions import measures

    return _bands(spark, d).groupBy(measures.band_name(F.col("band_code")).alias("band")).agg(F.count("*").alias("n"))
