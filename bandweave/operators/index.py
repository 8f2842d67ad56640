"""A stored index over sections: postings of title, labels, heading and body, in blocks of the corpus order.

A block is one task's and stands in one file, its terms in order, so that scores of
its sections are summed where they are read and what is shuffled is a row for each
query and section, not one for each term. A row is a term in a block: the sections of the block that have it, with their
lengths, how many they are and the shortest length. A section's BM25 part of a
term falls with its length, so the shortest bounds what any section of the block
can reach, and a search for the best sections reads the postings of few blocks:

1. each block's bound is the sum over the query's terms (counts and lengths only);
2. in each of SPREAD shares of the corpus the blocks of the highest bounds are
   scored, which gives a raw score that at least `top` sections reach;
3. all blocks whose bound reaches it are scored. What is left out can't be among the best.

Ties of the raw score go to the section that comes first in the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures, text
from ..storage import stored

#: Sections of a block, and shares of the corpus in the first round.
BLOCK, SPREAD = 128, 16
#: Raw scores are rounded to four places; a bound within this of the threshold counts as reaching it.
SLACK = 1e-3


@dataclass(frozen=True)
class Index:
    """blocks: (term, block, n, shortest, postings array<struct<ord, section_id, length>>); statistics: one row (n, average)."""

    blocks: DataFrame
    statistics: DataFrame


def section_text(title=None, labels=None, heading=None, body=None) -> Column:
    """What of a section is searched: title, labels, heading and body, those that there are."""
    given = [F.nullif(c, F.lit("")) for c in (title, F.array_join(labels, " ") if labels is not None else None, heading, body) if c is not None]
    return F.concat_ws(" ", *given)


def _postings(key: tuple[pa.Scalar, ...], sections: pa.Table) -> pa.Table:
    """The rows of one block, by term; a term's postings in the order of the corpus."""
    rows = sections.sort_by([("ord", "ascending"), ("section_id", "ascending")]).combine_chunks()
    tokens = rows["_t"].combine_chunks()
    length = pc.list_value_length(tokens).to_numpy()
    coded = tokens.flatten().dictionary_encode()
    named = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(named), np.int64)
    place[named] = np.arange(len(named))
    of = place[coded.indices.to_numpy()]
    owner = np.repeat(np.arange(len(length)), length)[np.argsort(of, kind="stable")]
    n = np.bincount(of, minlength=len(named))
    starts = np.concatenate(([0], np.cumsum(n)))
    one = pa.StructArray.from_arrays(
        [rows["ord"].combine_chunks().take(pa.array(owner)), rows["section_id"].combine_chunks().take(pa.array(owner)), pa.array(length[owner].astype(np.int32))],
        ["ord", "section_id", "length"],
    )
    return pa.table({
        "term": coded.dictionary.take(pa.array(named)), "block": pa.array(np.full(len(named), key[0].as_py())), "n": pa.array(n.astype(np.int32)),
        "shortest": pa.array(np.minimum.reduceat(length[owner], starts[:-1]).astype(np.int32)), "postings": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), one),
    })


def build(sections: DataFrame, path: str) -> None:
    """Write the index of sections (section_id, ord, text) under path; ord is the place in the corpus.

    Tokens are made once and shuffled once, as a section's array, to the task of
    their block; the statistics are counted on the way. A block's postings are at
    most BLOCK rows, so no group grows with the corpus.
    """
    spark, seen = sections.sparkSession, Observation()
    found = sections.select("section_id", F.col("ord").cast("long").alias("ord"), text.tokens(F.col("text")).alias("_t"))
    found = found.where(F.size("_t") > 0).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.size("_t").cast("long")).alias("tokens"))
    kind = found.schema["section_id"].dataType.simpleString()
    schema = f"term string, block long, n int, shortest int, postings array<struct<ord: long, section_id: {kind}, length: int>>"
    dealt = found.withColumn("block", F.floor(F.col("ord") / BLOCK)).groupBy("block")
    dealt.applyInArrow(_postings, schema).write.mode("overwrite").parquet(f"{path}/blocks")
    n, size = seen.get["n"], seen.get["tokens"]
    known = spark.createDataFrame([(n, size / n if n else None)], "n long, average double")
    known.coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/statistics"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether build() has finished there; the statistics are written last."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/statistics/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def frequencies(index: Index) -> DataFrame:
    """(term, df, n_blocks, shortest) of every term."""
    return index.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("n_blocks"), F.min("shortest").alias("shortest"))


def term_weights(index: Index, query: DataFrame) -> DataFrame:
    """Adds idf, mass (weight times idf), n and average to the query's terms (query_id, term, weight); unknown terms have frequency 0."""
    df = index.blocks.join(query.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    joined = query.join(df, "term", "left").crossJoin(F.broadcast(index.statistics))  # one row
    idf = measures.bm25_idf(F.col("n").cast("double"), F.coalesce("df", F.lit(0)))
    return joined.withColumn("idf", idf).withColumn("mass", F.col("weight") * F.col("idf"))


def _part(length: Column) -> Column:
    return measures.bm25_term(F.col("weight"), F.col("idf"), F.lit(1.0), length, F.col("average"))


def _scored(index: Index, weighted: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(query_id, section_id, ord, raw, matched, matched_terms) of the sections of the blocks given, of all without."""
    hit = index.blocks.select("term", "block", "postings").join(weighted, "term")
    rows = hit.select("query_id", "block", "term", "mass", "weight", "idf", "average", F.explode("postings").alias("p"))
    found = rows.groupBy("query_id", "block", F.col("p.section_id").alias("section_id")).agg(
        F.min("p.ord").alias("ord"), F.bround(F.sum(_part(F.col("p.length"))), 4).alias("raw"), F.sum("mass").alias("matched"),
        F.array_sort(F.collect_set("term")).alias("matched_terms"),
    )
    if blocks is not None:  # Spark moves this before the sums where the blocks are few enough to be sent to all tasks
        found = found.join(blocks, ["query_id", "block"], "left_semi")
    return found.drop("block")


def search(index: Index, query: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, section_id, ord, raw, score, mass, matched_terms) of the top sections of each query, or of all that share a term.

    score is raw over the query's best; mass is the matched share of the query's term mass.
    """
    weighted = stored(term_weights(index, query), "index-query")
    total = weighted.groupBy("query_id").agg(F.sum("mass").alias("total"))
    blocks = None
    if top is not None:
        bound = index.blocks.select("term", "block", "n", "shortest").join(weighted.drop("n"), "term")
        bound = bound.groupBy("query_id", "block").agg(F.sum(_part(F.col("shortest"))).alias("bound"), F.max("n").alias("n"))
        bound = stored(bound, "index-bounds")
        share = Window.partitionBy("query_id", F.pmod("block", F.lit(SPREAD))).orderBy(F.desc("bound"), "block")
        first = bound.withColumn("_r", F.row_number().over(share)).where(F.col("_r") <= -(-top // (BLOCK * SPREAD)) + 1)
        seen = _scored(index, weighted, stored(first.select("query_id", "block"), "index-first"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw")))
        sure = seen.select("query_id", "raw", place.alias("_r")).where(F.col("_r") == top).select("query_id", F.col("raw").alias("sure"))
        blocks = bound.join(sure, "query_id", "left").where(F.col("sure").isNull() | (F.col("bound") >= F.col("sure") - SLACK))
        blocks = stored(blocks.select("query_id", "block"), "index-reached")
    found = _scored(index, weighted, blocks).where("raw > 0")
    w = Window.partitionBy("query_id")
    if top is not None:
        found = found.withColumn("_r", F.row_number().over(w.orderBy(F.desc("raw"), "ord"))).where(F.col("_r") <= top).drop("_r")
    return (
        found.join(total, "query_id")
        .withColumn("score", F.bround(F.least(F.lit(1.0), F.col("raw") / F.max("raw").over(w)), 4))
        .withColumn("mass", F.bround(F.col("matched") / F.col("total"), 6))
        .drop("matched", "total")
    )
