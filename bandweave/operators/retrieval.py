"""Retrieval: data-derived cut-offs over searches of the index, vocabularies, page links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    BREAK_RATIO,
    IDF_LEAST,
    LINK_CONFIDENCE,
    SPACE_CANDIDATES,
    SPACE_LEAD,
    TOP_DOCUMENTS,
    TOP_HITS,
    TOP_TERMS,
)
from ..functions import text
from . import index
from .index import Index


def mass_floor(weighted: DataFrame) -> DataFrame:
    """(query_id, floor): median term mass over the query's whole mass."""
    total = F.sum("mass")
    return weighted.groupBy("query_id").agg(F.when(total > 0, F.median("mass") / total).otherwise(0.0).alias("floor"))


def natural_break(rows: DataFrame, group: str, score: str, *ties, ratio: float = BREAK_RATIO) -> DataFrame:
    """Rows of each group before the first whose score isn't positive or drops by the ratio."""
    w = Window.partitionBy(group).orderBy(F.desc(score), *ties)
    before = F.lag(score).over(w)
    ends = (before.isNotNull() & ((F.col(score) <= 0) | (before / F.col(score) >= ratio))).cast("int")
    running = F.max("_ends").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_ends", ends).withColumn("_cut", running).where("_cut = 0").drop("_ends", "_cut")


def keyword_hits(sections: Index, query: DataFrame) -> DataFrame:
    """The best TOP_HITS sections of each query above the floor and before the natural break; ties in the order of the corpus."""
    top = index.search(sections, query, TOP_HITS)
    floors = mass_floor(index.term_weights(sections, query))
    above = top.join(floors, "query_id").where("mass > floor").drop("floor")
    return natural_break(above, "query_id", "raw", "ord")


def separation(scored: DataFrame, group: str, score: str) -> DataFrame:
    """(group, separation): best over runner-up; infinite for a single or non-positive runner-up."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score)))
    top = scored.select(group, score, place.alias("_place")).where("_place <= 2").groupBy(group)
    two = top.agg(F.max(score).alias("_best"), F.max(F.when(F.col("_place") == 2, F.col(score))).alias("_second"))
    ratio = F.when(F.col("_second") > 0, F.col("_best") / F.col("_second")).otherwise(F.lit(float("inf")))
    return two.select(group, ratio.alias("separation"))


def mined_terms(passages: DataFrame, group: str, body: str, top: int = TOP_TERMS) -> DataFrame:
    """(group, term, n): the terms of most passages of a group, ties by term."""
    exploded = passages.select(group, F.explode(text.tokens(F.col(body))).alias("term"))
    counted = exploded.groupBy(group, "term").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "term"))
    return counted.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")


def vocabulary(sources: DataFrame, groups: int | None = None) -> DataFrame:
    """(capability_id, term, weight): the largest weight of a term's sources times the capabilities' inverse frequency.

    With fewer than IDF_LEAST capabilities nothing is discounted; weights of 0 are dropped.
    """
    strongest = sources.groupBy("capability_id", "term").agg(F.max("weight").alias("weight"))
    n = groups or strongest.select("capability_id").distinct().count()
    df = strongest.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(n)) / F.col("df")) if n >= IDF_LEAST else F.lit(1.0)
    out = strongest.join(df, "term").withColumn("weight", F.bround(F.col("weight") * idf, 6))
    return out.where("weight > 0").select("capability_id", "term", "weight")


def page_links(labels: DataFrame, above: DataFrame, spaces: DataFrame) -> DataFrame:
    """(page_id, capability_id, match_type, confidence): strongest link of each pair; spaces count only for pages without another."""
    levels = dict(LINK_CONFIDENCE)
    of = lambda df, kind: df.select("page_id", "capability_id", F.lit(kind).alias("match_type"), F.lit(levels[kind]).alias("confidence"))
    direct = of(labels, "label").unionByName(of(above, "ancestor"))
    weak = of(spaces, "space").join(direct.select("page_id").distinct(), "page_id", "left_anti")
    w = Window.partitionBy("page_id", "capability_id").orderBy(F.desc("confidence"))
    both = direct.unionByName(weak).withColumn("_n", F.row_number().over(w))
    return both.where("_n = 1").drop("_n")


def space_match(scores: DataFrame, space: str = "space", service: str = "service", score: str = "score") -> DataFrame:
    """(space, service, score, lead, state, place): the best candidates; a clear lead settles it, a single one is clear."""
    w = Window.partitionBy(space).orderBy(F.desc(score), service)
    second = F.lead(score).over(w)
    lead = F.when(second > 0, F.col(score) / second).otherwise(F.lit(float("inf")))
    state = F.when(F.col(score) <= 0, "unmatched").when(F.col("lead") >= SPACE_LEAD, "auto").otherwise("ambiguous")
    out = scores.withColumn("place", F.row_number().over(w)).withColumn("lead", lead)
    return out.withColumn("state", state).where(F.col("place") <= SPACE_CANDIDATES)


def rank_documents(docs: DataFrame, group: str, top: int = TOP_DOCUMENTS) -> DataFrame:
    """Structural before keyword documents, then by score and title; top of each group."""
    w = Window.partitionBy(group).orderBy(F.desc("structural"), F.desc("score"), F.lower("title"))
    return docs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def links_in_order(links: DataFrame) -> DataFrame:
    """links with place: a page's surest first, ties by capability."""
    w = Window.partitionBy("page_id").orderBy(F.desc("confidence"), "capability_id")
    return links.withColumn("place", F.row_number().over(w))
