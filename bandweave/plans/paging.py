"""Plans of pages, synchronisation and documents of two tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import absence, pages, retrieval
from .bindings import ABSENT, SCORES, TOKENS, evidence
from .registry import plan, read
from .retrieving import _POSTED, _corpus
from .scores import scores

_PLAIN = (
    "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '(?is)</t[dh]>\\s*<t[dh][^>]*>', ' | ', 'g'),"
    " '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"
)
_SECTIONS = rf"""
    cl AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'),
        '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
    pt AS (SELECT page_id, string_split(regexp_replace(h, '(?i)<h([1-6])\b[^>]*>', chr(1) || '\1', 'g'), chr(1)) AS p FROM cl),
    ex AS (SELECT page_id, i - 1 AS ordinal, p[i] AS part FROM pt, unnest(range(1, len(p) + 1)) r(i)),
    sc2 AS (SELECT page_id, ordinal::INT AS ordinal, CASE WHEN ordinal > 0 THEN part[1]::INT ELSE 0 END AS level,
        CASE WHEN ordinal > 0 THEN {_PLAIN.format("regexp_extract(part, '(?is)^[1-6](.*?)</h[1-6]\\s*>(.*)$', 1)")} ELSE '' END AS heading,
        CASE WHEN ordinal > 0 THEN {_PLAIN.format("regexp_extract(part, '(?is)^[1-6](.*?)</h[1-6]\\s*>(.*)$', 2)")} ELSE {_PLAIN.format("part")} END AS body FROM ex),
    se2 AS (SELECT * FROM sc2 WHERE heading <> '' OR body <> '')
"""


@plan("str15_page_sections", f"WITH {_SECTIONS} SELECT * FROM se2")
def str15(spark, d):
    return pages.sections(read(spark, d, "pages"))


@plan("str17_section_text", f"""
    WITH {_SECTIONS} SELECT page_id, string_agg(CASE WHEN heading = '' THEN body WHEN body = '' THEN heading ELSE heading || chr(10) || body END, chr(10) || chr(10) ORDER BY ordinal) AS text
    FROM se2 GROUP BY page_id
""")
def str17(spark, d):
    return pages.section_text(pages.sections(read(spark, d, "pages")))


@plan("str16_plain_text", f"SELECT page_id, {_PLAIN.format('html')} AS plain FROM pages")
def str16(spark, d):
    return read(spark, d, "pages").select("page_id", pages.plain(F.col("html")).alias("plain"))


@plan("str18_page_addresses", """
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://x.org/wiki/spaces/' || page_id WHEN 1 THEN url WHEN 2 THEN 'https://x.org' ELSE 'https://x.org/wiki/spaces/' || page_id END AS address FROM pages
""")
def str18(spark, d):
    k = F.col("page_id") % 4
    base = F.when(k == 3, "https://x.org/wiki/").otherwise("https://x.org//")
    path = F.when(k == 1, F.col("url")).when(k != 2, F.concat(F.lit("/spaces/"), F.col("page_id").cast("string")))
    return read(spark, d, "pages").select("page_id", pages.page_address(base, path).alias("address"))


@plan("str19_inline_marks", "SELECT page_id, 'see ' || page_id || ' now, bold and thin code' AS t FROM pages")
def str19(spark, d):
    marked = F.concat(F.lit("see ["), F.col("page_id").cast("string"), F.lit("](https://x.org/a) now, **bold** and *thin* `code`"))
    return read(spark, d, "pages").select("page_id", pages.inline_plain(marked).alias("t"))


@plan("str13_record_prose", """SELECT event_id, trim(concat_ws(' ', CASE WHEN event_id % 2 = 0 THEN event_type END, CASE WHEN event_id % 3 = 0 THEN 'fix ' || user_id END, CASE WHEN event_id % 5 = 0 THEN 'title' END)) AS prose FROM events""")
def str13(spark, d):
    i = F.col("event_id")
    payload = F.to_json(F.struct(
        F.struct(F.when(i % 2 == 0, F.col("event_type")).alias("summary")).alias("fields"), F.struct(F.when(i % 3 == 0, F.concat(F.lit("fix "), F.col("user_id"))).alias("message")).alias("commit"),
        F.when(i % 5 == 0, "title").alias("title"),
    ))
    paths = ("$.fields.summary", "$.fields.description", "$.commit.message", "$.title", "$.description")
    return read(spark, d, "events").select("event_id", F.trim(F.concat_ws(" ", *(F.get_json_object(payload, p) for p in paths))).alias("prose"))


@plan("str14_row_text", "SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS t FROM part")
def str14(spark, d):
    """All text columns of a row but ids, times and states."""
    rows = read(spark, d, "part")
    prose = [f.name for f in rows.schema if f.dataType.simpleString() == "string" and not f.name.endswith(("_id", "_key", "_at", "status"))]
    return rows.select("p_partkey", F.concat_ws(" ", *prose).alias("t"))


@plan("str23_canonical_hash", """SELECT event_id, sha256('{"a":' || event_id || ',"m":{"b":3,"y":"' || event_type || '"},"z":[1,"x"]}') AS h FROM events""")
def str23(spark, d):
    """Hash of JSON with sorted keys and no blanks, whatever the order and blanks it came with."""
    raw = F.concat(F.lit('{"z": [1, "x"], "a": '), F.col("event_id").cast("string"), F.lit(', "m": {"y": "'), F.col("event_type"), F.lit('", "b": 3}}'))
    return read(spark, d, "events").select("event_id", F.sha2(F.to_json(F.parse_json(raw)), 256).alias("h"))


_STORED = "st2 AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'old' ELSE sha256(coalesce(html, '')) END AS h FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT -1, 'gone')"


def _stored(spark, d):
    rows = read(spark, d, "pages").where("page_id % 3 > 0")
    old = F.when(F.col("page_id") % 5 == 0, "old").otherwise(text.content_hash(F.col("html")))
    return rows.select("page_id", old.alias("content_hash")).unionByName(spark.createDataFrame([(-1, "gone")], "page_id bigint, content_hash string"))


@plan("ret07_sync_actions", f"""
    WITH {_STORED} SELECT coalesce(p.page_id, s.page_id) AS page_id, CASE WHEN s.page_id IS NULL THEN 'new' WHEN p.page_id IS NULL THEN 'removed'
        WHEN s.h <> sha256(coalesce(html, '')) THEN 'changed' ELSE 'unchanged' END AS action FROM pages p FULL JOIN st2 s ON p.page_id = s.page_id
""")
def ret07(spark, d):
    return pages.sync(_stored(spark, d), read(spark, d, "pages"))


@plan("ret07_sections_after_sync", f"""
    WITH {_SECTIONS}, {_STORED} SELECT se2.page_id, ordinal, CASE WHEN s.h = sha256(coalesce(html, '')) THEN 'kept' ELSE heading END AS heading
    FROM se2 JOIN pages USING (page_id) LEFT JOIN st2 s ON s.page_id = se2.page_id
""")
def ret07_sections(spark, d):
    """Unchanged pages keep what was stored for them; the others have their sections replaced."""
    rows, known = read(spark, d, "pages"), _stored(spark, d)
    fresh = pages.sections(rows).select("page_id", "ordinal", "heading")
    old = fresh.join(known, "page_id", "left_semi").withColumn("heading", F.lit("kept"))
    gone = spark.createDataFrame([(-1, 0, "kept")], "page_id bigint, ordinal int, heading string")
    return pages.replace_sections(old.unionByName(gone), fresh, pages.sync(known, rows))


_CUT = f"""{_POSTED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, section_id) AS p FROM hits) WHERE p <= 500),
    ab AS (SELECT *, lag(raw) OVER (PARTITION BY query_id ORDER BY raw DESC, section_id) AS b FROM top WHERE mass > floor),
    ct AS (SELECT *, max(CASE WHEN b IS NOT NULL AND (raw <= 0 OR b / raw >= 2) THEN 1 ELSE 0 END)
                OVER (PARTITION BY query_id ORDER BY raw DESC, section_id ROWS UNBOUNDED PRECEDING) AS c FROM ab),
    kw AS (SELECT query_id, section_id, section_id // 4 AS page_id, score FROM ct WHERE c = 0),
    sl AS (SELECT DISTINCT query_id, page_id, 1.0::DOUBLE AS score FROM (SELECT item_id AS query_id, doc_id // 4 AS page_id FROM benchmark JOIN documents ON doc_id % 97 = item_id))"""


def _hits(spark, d):
    found = retrieval.keyword_hits(*_corpus(spark, d))
    return found.select("query_id", "section_id", F.floor(F.col("section_id") / 4).alias("page_id"), "score")


@plan("ret03_two_tiers", f"""
    WITH {_CUT}, k AS (SELECT query_id, page_id, max(score) AS score FROM kw GROUP BY 1, 2),
    u AS (SELECT query_id, page_id, score, true AS structural FROM sl UNION ALL SELECT k.query_id, k.page_id, k.score, false FROM k ANTI JOIN sl ON sl.query_id = k.query_id AND sl.page_id = k.page_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY structural DESC, score DESC, page_id) AS place FROM u)
    SELECT query_id, page_id, structural, score, place FROM r WHERE place <= 5
""")
def ret03(spark, d):
    """Four documents to a page; pages linked to a query come whole and first, keyword pages behind them."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    docs = read(spark, d, "documents").select("doc_id")
    links = items.join(docs, F.col("doc_id") % 97 == F.col("query_id")).select("query_id", F.floor(F.col("doc_id") / 4).alias("page_id"))
    return pages.two_tiers(links.distinct().withColumn("score", F.lit(1.0)), _hits(spark, d)).select("query_id", "page_id", "structural", "score", "place")


@plan("ret09_highlights", f"""
    WITH {_CUT}, p AS (SELECT DISTINCT query_id, page_id FROM kw)
    SELECT p.query_id, p.page_id, doc_id AS section_id, coalesce(score, 0) AS score FROM p JOIN documents ON doc_id // 4 = p.page_id
    LEFT JOIN kw ON kw.query_id = p.query_id AND kw.section_id = doc_id
""")
def ret09(spark, d):
    found = read(spark, d, "documents").select(F.col("doc_id").alias("section_id"), F.floor(F.col("doc_id") / 4).alias("page_id"))
    return pages.highlighted(found, _hits(spark, d).select("query_id", "section_id", "score"))


_TERMS = f"""
    t AS (SELECT p_brand AS capability_id, unnest({TOKENS.format("concat_ws(' ', p_name, p_brand)")}) AS term, 3.0 AS weight FROM part
        UNION ALL SELECT p_brand, unnest({TOKENS.format('lower(p_type)')}), 2.0 FROM part),
    m AS (SELECT capability_id, term, max(weight) AS weight FROM t GROUP BY 1, 2),
    dd AS (SELECT term, count(*) AS df FROM m GROUP BY 1), nn AS (SELECT count(DISTINCT capability_id) AS n FROM m),
    vo AS (SELECT capability_id, m.term, round_even(weight * ln(n::DOUBLE / df), 6) AS weight FROM m JOIN dd USING (term) CROSS JOIN nn
        WHERE round_even(weight * ln(n::DOUBLE / df), 6) > 0),
    qt AS (SELECT capability_id, string_agg(term, ' ' ORDER BY p) AS query FROM (
        SELECT *, row_number() OVER (PARTITION BY capability_id ORDER BY weight DESC, term) AS p FROM vo) WHERE p <= 25 GROUP BY 1)"""


def _vocabulary(spark, d):
    from .retrieving import agg25

    return agg25(spark, d)


@plan("srt09_query_terms", f"WITH {_TERMS} SELECT * FROM qt")
def srt09(spark, d):
    return pages.query_terms(_vocabulary(spark, d))


def _contexts(spark, d):
    left = absence.gaps(absence.simulate(scores(spark, d), ABSENT)).select("capability_id", "after")
    return pages.gap_contexts(left, evidence(spark, d).select("capability_id", "module_id"), _vocabulary(spark, d))


_GAPS = f"""{SCORES}, ga AS (SELECT capability_id, coalesce(max(score) FILTER (WHERE employee_id NOT IN (1, 3, 7)), 0.0) AS after FROM sc GROUP BY capability_id),
    mo AS (SELECT capability_id, string_agg(DISTINCT module_id, ',' ORDER BY module_id) AS modules FROM ev GROUP BY 1), {_TERMS}"""


@plan("ret05_gap_contexts", f"WITH {_GAPS} SELECT ga.capability_id, after, modules, query FROM ga LEFT JOIN mo USING (capability_id) LEFT JOIN qt USING (capability_id) WHERE after < 0.45")
def ret05(spark, d):
    return _contexts(spark, d).withColumn("modules", F.array_join("modules", ","))


@plan("ret06_transfer_package", f"""
    WITH {_GAPS}, g AS (SELECT *, row_number() OVER (ORDER BY after, capability_id) AS gap_no FROM ga WHERE after < 0.45),
    dr AS (SELECT p_brand AS capability_id, p_partkey AS page_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part WHERE p_size > 30),
    dl AS (SELECT capability_id, string_agg(page_id, ',' ORDER BY place) AS documents FROM dr WHERE place <= 5 GROUP BY 1)
    SELECT g.capability_id, gap_no, query, documents FROM g LEFT JOIN qt USING (capability_id) LEFT JOIN dl USING (capability_id)
""")
def ret06(spark, d):
    """What is left after an absence, worst first, with the documents of each capability."""
    linked = read(spark, d, "part").where("p_size > 30").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("page_id"), F.col("p_size").cast("double").alias("score"))
    nothing = linked.where("false")
    package = pages.transfer_package(_contexts(spark, d), pages.two_tiers(linked, nothing))
    return package.select("capability_id", "gap_no", "query", "documents")


@plan("qry14_gap_context", f"""
    WITH {_GAPS}, r AS (SELECT ga.capability_id, after, modules, query FROM ga LEFT JOIN mo USING (capability_id) LEFT JOIN qt USING (capability_id) WHERE after < 0.45)
    SELECT * FROM r WHERE capability_id = (SELECT min(capability_id) FROM r)
""")
def qry14_context(spark, d):
    """What would be searched for one gap: its modules and its strongest terms. Tables that leave no gap give no row."""
    found = _contexts(spark, d)
    first = found.agg(F.min("capability_id")).first()[0]
    one = found if first is None else pages.gap_context(found, first)
    return one.withColumn("modules", F.array_join("modules", ","))


@plan("qry14_retrieve", f"""
    WITH {_CUT}, k AS (SELECT query_id, page_id, max(score) AS score FROM kw GROUP BY 1, 2),
    u AS (SELECT query_id, page_id, score, true AS structural FROM sl UNION ALL SELECT k.query_id, k.page_id, k.score, false FROM k ANTI JOIN sl ON sl.query_id = k.query_id AND sl.page_id = k.page_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY structural DESC, score DESC, page_id) AS place FROM u)
    SELECT query_id, page_id, structural, score, place FROM r WHERE place <= 5 AND query_id = (SELECT max(item_id) FROM benchmark)
""")
def qry14_retrieve(spark, d):
    """The documents of one query, from the index."""
    sections, terms = _corpus(spark, d)
    one = read(spark, d, "benchmark").agg(F.max("item_id")).first()[0]
    docs = read(spark, d, "documents").where(F.col("doc_id") % 97 == F.lit(one)).select(F.lit(one).alias("query_id"), F.floor(F.col("doc_id") / 4).alias("page_id"))
    linked = docs.distinct().withColumn("score", F.lit(1.0))
    found = pages.retrieve(sections, terms.where(F.col("query_id") == F.lit(one)), linked, F.floor(F.col("section_id") / 4))
    return found.select("query_id", "page_id", "structural", "score", "place")
