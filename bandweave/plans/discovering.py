"""Plans of discovery: wide members, merging over sources, votes and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery, similarity
from .bindings import signatures
from .ordinal import _SIG
from .registry import plan, read

_WORDS = "string_split(lower(p_type), ' ')"


def _typed(spark, d):
    """Parts as items of their brand: the words of the type, and for odd sizes one more."""
    words = F.split(F.lower("p_type"), " ")
    odd = F.when(F.col("p_size") % 2 == 1, F.array_append(words, F.lit("odd"))).otherwise(words)
    return read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("source"), F.array_distinct(odd).alias("signature"))


@plan("joi10_wide_members", f"""
    WITH i AS (SELECT p_partkey AS item_id, p_brand AS source, list_distinct({_WORDS} || CASE WHEN p_size % 2 = 1 THEN ['odd'] ELSE [] END) AS s FROM part),
    l AS (SELECT DISTINCT 'L' || {_WORDS}[1] AS cluster, p_brand AS source, [{_WORDS}[1], 'odd'] AS common FROM part)
    SELECT cluster || source AS cluster, item_id FROM l JOIN i USING (source) WHERE len(list_intersect(common, s)) = len(common)
""")
def joi10(spark, d):
    first = F.split(F.lower("p_type"), " ")[0]
    leaf = read(spark, d, "part").select(F.concat(F.lit("L"), first, "p_brand").alias("cluster"), F.col("p_brand").alias("source"), F.array(first, F.lit("odd")).alias("common"))
    return discovery.wide_members(_typed(spark, d), leaf.distinct())


@plan("gra03_discovery", f"""
    WITH i AS (SELECT p_partkey AS item, p_brand AS source, lower(p_type) AS t, p_size % 2 = 1 AS odd FROM part),
    l AS (SELECT source, t, min(item) AS cluster FROM i GROUP BY 1, 2)
    SELECT l.cluster, l.source, i.item AS item_id FROM l JOIN i ON i.source = l.source AND i.t = l.t
""")
def gra03(spark, d):
    """Leaves of one type each (with and without the odd word), joined by what holds their common words."""
    return discovery.memberships(_typed(spark, d), 0.5)


def _keys(spark, d):
    def of(df, number, nation, source, cut, start):
        n = F.col(number)
        rows = read(spark, d, df).select((n + start).alias("leaf"), F.lit(source).alias("source"), (n % cut).alias("t"), F.col(nation).alias("s"))
        ticket = F.when(F.col("t") > 3, F.concat(F.lit("PAY-"), F.col("t")))
        return rows.select("leaf", "source", F.explode(F.array_compact(F.array(ticket, F.concat(F.lit("SVC:"), F.col("s"))))).alias("key"))

    return of("supplier", "s_suppkey", "s_nationkey", "github", 50, 0).unionByName(of("customer", "c_custkey", "c_nationkey", "jira", 70, 100_000))


@plan("joi11_cross_source", """
    WITH c AS (SELECT s_suppkey AS p, unnest([CASE WHEN s_suppkey % 50 > 3 THEN 'PAY-' || s_suppkey % 50 END, 'SVC:' || s_nationkey]) AS k FROM supplier),
    o AS (SELECT c_custkey + 100000 AS leaf, unnest([CASE WHEN c_custkey % 70 > 3 THEN 'PAY-' || c_custkey % 70 END, 'SVC:' || c_nationkey]) AS k FROM customer),
    a AS (SELECT leaf, min(p) AS parent FROM o JOIN c USING (k) WHERE k NOT LIKE 'SVC:%' GROUP BY leaf),
    b AS (SELECT leaf, min(p) AS parent FROM o JOIN c USING (k) WHERE leaf NOT IN (SELECT leaf FROM a) GROUP BY leaf),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT leaf, parent FROM u UNION ALL SELECT DISTINCT parent, parent FROM u
""")
def joi11(spark, d):
    return discovery.merge_sources(_keys(spark, d))


@plan("joi13_unclassified", """
    SELECT event_id AS item_id FROM events WHERE event_type = 'click' AND value >= 2 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50)
""")
def joi13(spark, d):
    e = read(spark, d, "events").withColumnRenamed("event_id", "item_id")
    buyers = e.where("event_type = 'purchase' AND value > 50").select("user_id").distinct()
    members = e.join(buyers, "user_id", "left_semi").select("item_id")
    items = e.select("item_id", F.when(F.col("event_type") == "click", "jira").otherwise("github").alias("source"), (F.col("value") >= 2).alias("eligible"))
    return discovery.unclassified(items, members).select("item_id")


@plan("joi14_cluster_texts", "SELECT p_type AS cluster, string_agg(p_name, ' ' ORDER BY p_partkey) AS summary FROM part GROUP BY 1")
def joi14(spark, d):
    p = read(spark, d, "part").withColumnRenamed("p_partkey", "item_id")
    return discovery.cluster_texts(p.select(F.col("p_type").alias("cluster"), "item_id"), p.select("item_id", F.col("p_name").alias("title")))


_FOLDERS = f"""f AS (SELECT p_brand AS cluster, p_partkey AS item, unnest(list_distinct(list_concat({_WORDS}[1:2], CASE WHEN p_size % 7 = 0 THEN ['tin'] ELSE [] END))) AS folder FROM part),
    n(k, prefix) AS (VALUES ('C1', 'promo'), ('C2', 'burnished'), ('C3', 'tin'), ('C4', 'standard'), ('C5', 'economy'), ('C6', 'small')),
    h AS (SELECT cluster, item, count(DISTINCT k) AS c, min(k) AS k FROM f JOIN n ON folder = prefix GROUP BY 1, 2),
    v AS (SELECT cluster, k AS key, count(*) AS votes FROM h WHERE c = 1 GROUP BY 1, 2)"""


def _votes(spark, d):
    words = F.slice(F.split(F.lower("p_type"), " "), 1, 2)
    more = F.when(F.col("p_size") % 7 == 0, F.array_append(words, F.lit("tin"))).otherwise(words)
    items = read(spark, d, "part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("item_id"), F.explode(F.array_distinct(more)).alias("folder"))
    names = [("C1", "promo"), ("C2", "burnished"), ("C3", "tin"), ("C4", "standard"), ("C5", "economy"), ("C6", "small")]
    return discovery.name_votes(items, spark.createDataFrame(names, "key string, prefix string"))


@plan("agg18_name_votes", f"""
    WITH {_FOLDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY votes DESC, key) AS n FROM v) SELECT cluster, key, votes FROM r WHERE n = 1
""")
def agg18(spark, d):
    return discovery.top_votes(_votes(spark, d))


@plan("agg18_assigned_names", f"""
    WITH RECURSIVE {_FOLDERS}, a(step, cluster, key, used) AS (
        SELECT 0, '', '', []::VARCHAR[]
        UNION ALL
        SELECT step + 1, w.cluster, w.key, list_append(used, w.key) FROM a, LATERAL (
            SELECT cluster, key FROM v WHERE v.cluster > a.cluster AND NOT list_contains(a.used, v.key) ORDER BY cluster, votes DESC, key LIMIT 1) w)
    SELECT cluster, key FROM a WHERE step > 0
""")
def agg18_assigned(spark, d):
    return spark.createDataFrame(discovery.assign_names(_votes(spark, d)), "cluster string, key string")


@plan("agg19_proposed_names", """
    WITH s AS (SELECT p_brand AS cluster, unnest([p_type, 'x_p' || p_size % 3]) AS s FROM part),
    c AS (SELECT cluster, s, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, s) AS p FROM c)
    SELECT cluster, array_to_string(list_transform(string_split(s, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM r WHERE p = 1
""")
def agg19(spark, d):
    segments = F.array("p_type", F.concat(F.lit("x_p"), F.col("p_size") % 3))
    return discovery.proposed_names(read(spark, d, "part").select(F.col("p_brand").alias("cluster"), F.explode(segments).alias("segment")))


@plan("agg20_naming_summary", """
    WITH t AS (SELECT DISTINCT p_brand AS cluster, 'dir:' || p_size AS f, 'label:' || p_type AS g FROM part),
    a AS (SELECT cluster, f AS x, row_number() OVER (PARTITION BY cluster ORDER BY f) AS n FROM (SELECT DISTINCT cluster, f FROM t)),
    b AS (SELECT cluster, g AS x, row_number() OVER (PARTITION BY cluster ORDER BY g) AS n FROM (SELECT DISTINCT cluster, g FROM t))
    SELECT cluster, (SELECT string_agg(x, ',' ORDER BY x) FROM a WHERE a.cluster = c.cluster AND n <= 12) AS folders,
        (SELECT string_agg(x, ',' ORDER BY x) FROM b WHERE b.cluster = c.cluster AND n <= 8) AS fields FROM (SELECT DISTINCT cluster FROM t) c
""")
def agg20(spark, d):
    token = F.explode(F.array(F.concat(F.lit("dir:"), F.col("p_size").cast("string")), F.concat(F.lit("label:"), "p_type")))
    found = discovery.naming_summary(read(spark, d, "part").select(F.col("p_brand").alias("cluster"), token.alias("token")))
    return found.select("cluster", F.array_join("folders", ",").alias("folders"), F.array_join("fields", ",").alias("fields"))


@plan("flt11_name_guard", """
    WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN p_name || ' one two three four five' WHEN 2 THEN 'Misc ' || p_brand
        WHEN 3 THEN repeat('long', 13) WHEN 4 THEN '  Ledger  ' ELSE p_brand END AS name, p_size > 25 AS taken FROM part)
    SELECT p_partkey, CASE WHEN trim(name) = '' OR length(trim(name)) > 48 THEN 'length' WHEN len(string_split(trim(name), ' ')) > 5 THEN 'too many words'
        WHEN lower(name) LIKE '%misc%' OR lower(name) LIKE '%various%' THEN 'banned word' WHEN taken THEN 'duplicate among siblings' END AS fault FROM n
""")
def flt11(spark, d):
    k = F.col("p_partkey") % 6
    name = (
        F.when(k == 0, "").when(k == 1, F.concat("p_name", F.lit(" one two three four five"))).when(k == 2, F.concat(F.lit("Misc "), "p_brand"))
        .when(k == 3, F.repeat(F.lit("long"), 13)).when(k == 4, "  Ledger  ").otherwise(F.col("p_brand"))
    )
    return read(spark, d, "part").select("p_partkey", discovery.name_fault(name, F.col("p_size") > 25, ("misc", "various")).alias("fault"))


@plan("qry15_threshold_sweep", f"WITH {_SIG}, h(threshold) AS (VALUES (0.6::DOUBLE), (0.7), (0.8), (0.9)) SELECT threshold, count(*) AS n FROM pr JOIN h ON j >= threshold GROUP BY 1")
def qry15(spark, d):
    return discovery.sweep(similarity.similar_signatures(signatures(spark, d), 0.6), [0.6, 0.7, 0.8, 0.9])


@plan("qry17_review_gate", """
    SELECT CASE WHEN event_type = 'view' THEN 'approved' ELSE event_type END AS state, count(*) AS n FROM events GROUP BY 1
""")
def qry17(spark, d):
    state = F.when(F.col("event_type") == "view", "pending_review").otherwise(F.col("event_type"))
    return discovery.reviewed(read(spark, d, "events").select(state.alias("state")), True).groupBy("state").agg(F.count("*").alias("n"))
