"""Pages: sections under headings, addresses, synchronisation, and documents of two tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TOP_DOCUMENTS
from ..functions import text
from . import retrieval
from .index import Index

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain(markup: Column) -> Column:
    """Text of markup: cells of a row behind bars, tags gone, common entities read, blanks folded."""
    out = F.regexp_replace(markup, r"(?is)</t[dh]>\s*<t[dh][^>]*>", " | ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, shown in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(shown))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def sections(pages: DataFrame, body: str = "html") -> DataFrame:
    """(page_id, ordinal, level, heading, body): what stands before the first heading, then each heading's part.

    Scripts, styles and comments are left out, and parts without heading and text
    too; code in CDATA is kept word for word. A page without headings is one
    section; null and empty pages have none.
    """
    clean = F.coalesce(F.col(body), F.lit(""))
    for gone in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"):
        clean = F.regexp_replace(clean, gone, " ")
    clean = F.regexp_replace(clean, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    parts = F.split(F.regexp_replace(clean, r"(?i)<h([1-6])\b[^>]*>", "\u0001$1"), "\u0001")
    rows = pages.select("page_id", F.posexplode(parts).alias("ordinal", "part"))
    headed = F.col("ordinal") > 0
    level = F.when(headed, F.substring("part", 1, 1).cast("int")).otherwise(0)
    cut = r"(?is)^[1-6](.*?)</h[1-6]\s*>(.*)$"
    heading = F.when(headed, plain(F.regexp_extract("part", cut, 1))).otherwise("")
    rest = F.when(headed, plain(F.regexp_extract("part", cut, 2))).otherwise(plain(F.col("part")))
    found = rows.select("page_id", "ordinal", level.alias("level"), heading.alias("heading"), rest.alias("body"))
    return found.where("heading <> '' OR body <> ''")


def section_text(found: DataFrame) -> DataFrame:
    """(page_id, text): headings and bodies of a page in order, blank lines between."""
    one = F.struct("ordinal", F.array_join(F.filter(F.array("heading", "body"), lambda x: x != ""), "\n").alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda o: o["t"]), "\n\n")
    return found.groupBy("page_id").agg(whole.alias("text"))


def page_address(base: Column, path: Column) -> Column:
    """A page's address: paths are relative to the wiki root, whole addresses stand, no path is the site."""
    root = F.regexp_replace(base, "/+$", "")
    wiki = F.when(root.endswith("/wiki"), root).otherwise(F.concat(root, F.lit("/wiki")))
    return F.when(F.coalesce(path, F.lit("")) == "", root).when(path.startswith("http"), path).otherwise(F.concat(wiki, path))


def inline_plain(markdown: Column) -> Column:
    """Markdown without links, emphasis and code marks."""
    for pattern in (r"\[([^\]]+)\]\([^)]*\)", r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"`([^`]+)`"):
        markdown = F.regexp_replace(markdown, pattern, "$1")
    return markdown


def sync(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(page_id, action): new and changed pages are parsed again, equal hashes left alone, missing ones removed.

    stored has page_id and content_hash, incoming page_id and html.
    """
    now = incoming.select("page_id", text.content_hash(F.col("html")).alias("new_hash"))
    both = stored.select("page_id", "content_hash").join(now, "page_id", "full_outer")
    action = (
        F.when(F.col("content_hash").isNull(), "new").when(F.col("new_hash").isNull(), "removed")
        .when(F.col("content_hash") != F.col("new_hash"), "changed").otherwise("unchanged")
    )
    return both.select("page_id", action.alias("action"))


def replace_sections(stored: DataFrame, fresh: DataFrame, actions: DataFrame) -> DataFrame:
    """Sections after a synchronisation: those of pages parsed again are replaced as a whole, removed pages lose theirs."""
    kept = stored.join(actions.where("action <> 'unchanged'").select("page_id"), "page_id", "left_anti")
    parsed = fresh.join(actions.where("action IN ('new', 'changed')").select("page_id"), "page_id", "left_semi")
    return kept.unionByName(parsed)


def two_tiers(structural: DataFrame, keyword: DataFrame, top: int = TOP_DOCUMENTS) -> DataFrame:
    """(query_id, page_id, structural, score, place): linked pages first, then keyword pages that aren't linked; top of each query.

    structural has query_id, page_id, score; keyword query_id, page_id, score of
    sections, of which a page's best counts.
    """
    best = keyword.groupBy("query_id", "page_id").agg(F.max("score").alias("score"))
    rest = best.join(structural.select("query_id", "page_id"), ["query_id", "page_id"], "left_anti")
    both = structural.select("query_id", "page_id", "score", F.lit(True).alias("structural")).unionByName(rest.withColumn("structural", F.lit(False)))
    w = Window.partitionBy("query_id").orderBy(F.desc("structural"), F.desc("score"), "page_id")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def highlighted(found: DataFrame, hits: DataFrame) -> DataFrame:
    """All sections of pages with a hit, each with its score, 0 where it has none; found has page_id, section_id, hits query_id, section_id, score."""
    pages = hits.join(found, "section_id").select("query_id", "page_id").distinct()
    every = pages.join(found, "page_id")
    return every.join(hits, ["query_id", "section_id"], "left").select("query_id", "page_id", "section_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def gap_contexts(gaps: DataFrame, modules: DataFrame, weighted: DataFrame, terms: int = 25) -> DataFrame:
    """(capability_id, after, modules, query): a gap with its modules and its strongest terms."""
    named = modules.groupBy("capability_id").agg(F.array_sort(F.collect_set("module_id")).alias("modules"))
    return gaps.join(named, "capability_id", "left").join(query_terms(weighted, terms), "capability_id", "left")


def query_terms(weighted: DataFrame, terms: int = 25) -> DataFrame:
    """(capability_id, query): the strongest terms of a vocabulary, ties by term."""
    w = Window.partitionBy("capability_id").orderBy(F.desc("weight"), "term")
    top = weighted.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= terms)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", "term"))), lambda o: o["term"])
    return top.groupBy("capability_id").agg(F.array_join(listed, " ").alias("query"))


def transfer_package(contexts: DataFrame, documents: DataFrame) -> DataFrame:
    """Gaps in order of what is left of them, each with its documents in order; gaps without documents stay."""
    order = F.row_number().over(Window.orderBy("after", "capability_id"))  # a row for each capability
    found = documents.groupBy(F.col("query_id").alias("capability_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "page_id"))), lambda o: o["page_id"].cast("string")), ",").alias("documents")
    )
    return contexts.withColumn("gap_no", order).join(found, "capability_id", "left")


def gap_context(contexts: DataFrame, capability) -> DataFrame:
    """The one context of a capability; KeyError if there is none of that name."""
    found = contexts.where(F.col("capability_id") == F.lit(capability))
    if found.isEmpty():
        raise KeyError(capability)
    return found


def retrieve(sections: Index, query: DataFrame, structural: DataFrame, page_of, top: int = TOP_DOCUMENTS) -> DataFrame:
    """two_tiers() of one query's terms (query_id, term, weight): linked pages, then pages with keyword hits of the index.

    page_of gives a section's page from its section_id. Without terms only linked
    pages are found.
    """
    hits = retrieval.keyword_hits(sections, query).select("query_id", page_of.alias("page_id"), "score")
    return two_tiers(structural, hits, top)
