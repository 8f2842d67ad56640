"""Plans of retrieval."""

from __future__ import annotations

import zlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import index, retrieval
from ..storage import shared_dir
from .bindings import TOKENS
from .registry import plan, read

_POSTED = f"""
    tk AS (SELECT doc_id AS section_id, {TOKENS.format('text')} AS t FROM documents),
    po AS (SELECT section_id, len(t) AS length, unnest(t) AS term FROM tk),
    st AS (SELECT count(*) AS n, avg(len(t)) AS average FROM tk WHERE len(t) > 0),
    df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
    qq AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
    q AS (SELECT query_id, term, 1.0 + length(term) % 3 AS weight FROM qq),
    w AS (SELECT query_id, q.term, weight, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf, average,
                 weight * ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS mass
          FROM q LEFT JOIN df ON df.term = q.term CROSS JOIN st),
    tot AS (SELECT query_id, sum(mass) AS total, median(mass) AS mid FROM w GROUP BY query_id),
    se AS (SELECT query_id, section_id, round_even(sum(weight * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * length / average))), 4) AS raw, sum(mass) AS m
           FROM po JOIN w USING (term) GROUP BY query_id, section_id),
    hits AS (SELECT query_id, section_id, raw, round_even(least(1.0, raw / max(raw) OVER (PARTITION BY query_id)), 4) AS score,
                    round_even(m / total, 6) AS mass, mid / total AS floor FROM se JOIN tot USING (query_id) WHERE raw > 0)
"""


def _index(spark, d, name, sections):
    """The index of the table, built once and then read by all searches of the application."""
    path = f"{shared_dir(spark)}/bandweave/index-{name}-{spark.sparkContext.applicationId}-{zlib.crc32(d.encode()):08x}"
    if not index.exists(spark, path):
        index.build(sections, path)
    return index.load(spark, path)


def _corpus(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("section_id"), F.col("doc_id").alias("ord"), F.col("text"))
    terms = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.tokens(F.col("text"))).alias("term"))
    return _index(spark, d, "bodies", docs), terms.withColumn("weight", 1.0 + F.length("term") % 3)


@plan("ret01_index", f"""
    WITH t AS (SELECT doc_id, {TOKENS.format("concat_ws(' ', nullif(source, ''), nullif(array_to_string([lang, source], ' '), ''), nullif(split_part(text, chr(10), 1), ''), nullif(text, ''))")} AS t FROM documents),
    p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM t)
    SELECT term, count(*) AS df, count(DISTINCT doc_id // 128) AS n_blocks, min(length) AS shortest FROM p GROUP BY term
""")
def ret01(spark, d):
    """Source as title, language and source as labels, the first line as heading."""
    fields = index.section_text(F.col("source"), F.array("lang", "source"), F.substring_index("text", "\n", 1), F.col("text"))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("section_id"), F.col("doc_id").alias("ord"), fields.alias("text"))
    return index.frequencies(_index(spark, d, "fields", docs))


@plan("ret02_bm25_search", f"WITH {_POSTED} SELECT query_id, section_id, raw, score, mass FROM hits")
def ret02(spark, d):
    return index.search(*_corpus(spark, d)).select("query_id", "section_id", "raw", "score", "mass")


@plan("ret02_best_sections", f"""
    WITH {_POSTED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, section_id) AS place FROM hits)
    SELECT query_id, section_id, raw, score, mass, place FROM r WHERE place <= 20
""")
def ret02_best(spark, d):
    """The search that prunes blocks."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "ord"))
    return index.search(*_corpus(spark, d), top=20).withColumn("place", place).drop("ord", "matched_terms")


@plan("flt05_mass_floor", f"WITH {_POSTED} SELECT query_id, round_even(mid / total, 6) AS floor FROM tot")
def flt05(spark, d):
    return retrieval.mass_floor(index.term_weights(*_corpus(spark, d))).select("query_id", F.bround("floor", 6).alias("floor"))


@plan("flt07_keyword_hits", f"""
    WITH {_POSTED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, section_id) AS p FROM hits) WHERE p <= 500),
    ab AS (SELECT *, lag(raw) OVER (PARTITION BY query_id ORDER BY raw DESC, section_id) AS b FROM top WHERE mass > floor),
    cut AS (SELECT *, max(CASE WHEN b IS NOT NULL AND (raw <= 0 OR b / raw >= 2) THEN 1 ELSE 0 END)
                OVER (PARTITION BY query_id ORDER BY raw DESC, section_id ROWS UNBOUNDED PRECEDING) AS c FROM ab)
    SELECT query_id, section_id, raw FROM cut WHERE c = 0
""")
def flt07(spark, d):
    return retrieval.keyword_hits(*_corpus(spark, d)).select("query_id", "section_id", "raw")


@plan("agg26_corpus_statistics", f"WITH {_POSTED} SELECT n, round_even(average, 6) AS average FROM st")
def agg26(spark, d):
    return _corpus(spark, d)[0].statistics.select("n", F.bround("average", 6).alias("average"))


@plan("flt06_natural_break", """
    WITH s AS (SELECT p_brand, p_partkey, p_size, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS b FROM part),
    c AS (SELECT *, max(CASE WHEN b IS NOT NULL AND (p_size <= 0 OR b / p_size >= 1.3) THEN 1 ELSE 0 END)
              OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS x FROM s)
    SELECT p_brand, p_partkey, p_size FROM c WHERE x = 0
""")
def flt06(spark, d):
    rows = read(spark, d, "part").select("p_brand", "p_partkey", "p_size")
    return retrieval.natural_break(rows, "p_brand", "p_size", "p_partkey", ratio=1.3)


@plan("agg34_separation", """
    WITH r AS (SELECT p_brand, p_retailprice AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS n FROM part)
    SELECT p_brand, round_even(coalesce(max(s) FILTER (WHERE n = 1) / max(s) FILTER (WHERE n = 2), 'inf'::DOUBLE), 6) AS separation FROM r GROUP BY 1
""")
def agg34(spark, d):
    return retrieval.separation(read(spark, d, "part"), "p_brand", "p_retailprice").select("p_brand", F.bround("separation", 6).alias("separation"))


@plan("agg24_mined_terms", f"""
    WITH t AS (SELECT role, unnest({TOKENS.format('text')}) AS term FROM conversations),
    c AS (SELECT role, term, count(*) AS n FROM t GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, term) AS p FROM c)
    SELECT role, term, n FROM r WHERE p <= 40
""")
def agg24(spark, d):
    return retrieval.mined_terms(read(spark, d, "conversations"), "role", "text")


@plan("agg25_vocabulary", f"""
    WITH t AS (SELECT p_brand AS capability_id, unnest({TOKENS.format("concat_ws(' ', p_name, p_brand)")}) AS term, 3.0 AS weight FROM part
        UNION ALL SELECT p_brand, unnest({TOKENS.format('lower(p_type)')}), 2.0 FROM part),
    m AS (SELECT capability_id, term, max(weight) AS weight FROM t GROUP BY 1, 2),
    d AS (SELECT term, count(*) AS df FROM m GROUP BY 1), n AS (SELECT count(DISTINCT capability_id) AS n FROM m)
    SELECT capability_id, m.term, round_even(weight * ln(n::DOUBLE / df), 6) AS weight FROM m JOIN d USING (term) CROSS JOIN n
    WHERE round_even(weight * ln(n::DOUBLE / df), 6) > 0
""")
def agg25(spark, d):
    p = read(spark, d, "part")
    strong = p.select(F.col("p_brand").alias("capability_id"), F.explode(text.tokens(F.concat_ws(" ", "p_name", "p_brand"))).alias("term"), F.lit(3.0).alias("weight"))
    weak = p.select(F.col("p_brand").alias("capability_id"), F.explode(text.tokens(F.lower("p_type"))).alias("term"), F.lit(2.0).alias("weight"))
    return retrieval.vocabulary(strong.unionByName(weak))


@plan("joi20_page_links", """
    WITH l AS (SELECT DISTINCT c_custkey AS page_id, c_mktsegment AS capability_id FROM customer WHERE c_custkey % 3 = 0),
    a AS (SELECT DISTINCT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'OTHER' END AS capability_id FROM customer WHERE c_custkey % 3 < 2),
    s AS (SELECT c_custkey AS page_id, 'SPACE' AS capability_id FROM customer),
    u AS (SELECT *, 'label' AS match_type, 1.0 AS confidence FROM l UNION ALL SELECT *, 'ancestor', 0.8 FROM a
        UNION ALL SELECT *, 'space', 0.6 FROM s WHERE page_id NOT IN (SELECT page_id FROM l UNION SELECT page_id FROM a))
    SELECT page_id, capability_id, arg_max(match_type, confidence) AS match_type, max(confidence)::DOUBLE AS confidence FROM u GROUP BY 1, 2
""")
def joi20(spark, d):
    c = read(spark, d, "customer").withColumnsRenamed({"c_custkey": "page_id", "c_mktsegment": "capability_id"})
    above = c.where("page_id % 3 < 2").withColumn("capability_id", F.when(F.col("page_id") % 2 == 0, F.col("capability_id")).otherwise("OTHER"))
    return retrieval.page_links(c.where("page_id % 3 = 0"), above, c.withColumn("capability_id", F.lit("SPACE")))


@plan("joi21_space_match", """
    WITH g AS (SELECT p_type AS space, p_brand AS service, sum(p_size)::DOUBLE AS score FROM part GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY space ORDER BY score DESC, service))
    SELECT space, service, score, place, CASE WHEN score <= 0 THEN 'unmatched' WHEN nxt IS NULL OR nxt <= 0 OR score / nxt >= 2 THEN 'auto' ELSE 'ambiguous' END AS state
    FROM r WHERE place <= 4
""")
def joi21(spark, d):
    g = read(spark, d, "part").groupBy(F.col("p_type").alias("space"), F.col("p_brand").alias("service")).agg(F.sum("p_size").cast("double").alias("score"))
    return retrieval.space_match(g).select("space", "service", "score", "place", "state")


@plan("srt02_document_rank", """
    WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_type = 'ECONOMY' DESC, p_size DESC, lower(p_name || p_partkey)) AS place FROM part)
    SELECT p_brand, p_partkey, place FROM r WHERE place <= 5
""")
def srt02(spark, d):
    rows = read(spark, d, "part").select(
        "p_brand", "p_partkey", (F.col("p_type") == "ECONOMY").alias("structural"), F.col("p_size").alias("score"),
        F.concat("p_name", F.col("p_partkey").cast("string")).alias("title"),
    )
    return retrieval.rank_documents(rows, "p_brand").select("p_brand", "p_partkey", "place")
