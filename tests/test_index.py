"""The stored index: pruned searches give what scoring every section gives; fields, ties and hard cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bandweave.operators import index


@pytest.fixture
def corpus(spark, tmp_path, monkeypatch):
    """Sections of few words in small blocks; the rare ones stand in few blocks."""
    monkeypatch.setattr(index, "BLOCK", 8)
    monkeypatch.setattr(index, "SPREAD", 2)
    rng = random.Random(1)
    words = [f"word{k}" for k in range(60)]
    rows = [(f"s{k}", k, " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 30)))) for k in range(400)]
    rows += [("null", 400, None), ("empty", 401, "")]
    index.build(spark.createDataFrame(rows, "section_id string, ord long, text string"), str(tmp_path))
    query = spark.createDataFrame([(q, f"word{t}", 1.0 + t % 3) for q, ts in enumerate(([0, 50], [3], [59, 58, 57], [99], [1, 2, 99])) for t in ts], "query_id int, term string, weight double")
    return index.load(spark, str(tmp_path)), query


@pytest.mark.parametrize("top", [1, 30, 1000])
def test_pruned_search_is_the_head_of_the_whole(corpus, top):
    found, query = corpus
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "ord"))
    whole = index.search(found, query).withColumn("_p", place).where(F.col("_p") <= top).drop("_p")
    rows = lambda df: sorted((r.query_id, r.section_id, r.raw, r.score, r.mass, r.matched_terms) for r in df.collect())
    got = rows(index.search(found, query, top))
    assert got == rows(whole)
    assert len(got) > 0


def test_blocks_below_the_threshold_are_not_scored(spark, tmp_path, monkeypatch):
    """One short section has the term; the other blocks' sections are long."""
    monkeypatch.setattr(index, "BLOCK", 4)
    monkeypatch.setattr(index, "SPREAD", 1)
    long = " ".join(f"w{k:03d}" for k in range(200))
    rows = [(k, k, "needle" if k == 37 else f"needle {long}") for k in range(80)]
    index.build(spark.createDataFrame(rows, "section_id int, ord long, text string"), str(tmp_path))
    read = []
    plain = index._scored
    monkeypatch.setattr(index, "_scored", lambda i, w, b=None: (read.append(b.count()), plain(i, w, b))[1])
    query = spark.createDataFrame([(0, "needle", 1.0)], "query_id int, term string, weight double")
    assert [r.section_id for r in index.search(index.load(spark, str(tmp_path)), query, 1).collect()] == [37]
    assert read == [2, 1]  # of 20


def test_fields_are_searched_and_equal_scores_keep_the_order_of_the_corpus(spark, tmp_path):
    rows = [(1, 9, "Recovery", ["backup"], "Steps", "restore everything"), (2, 3, None, None, None, "restore everything twice over now"), (3, 1, "", [], "", None)]
    df = spark.createDataFrame(rows, "section_id int, ord long, title string, labels array<string>, heading string, body string")
    fields = index.section_text(F.col("title"), F.col("labels"), F.col("heading"), F.col("body"))
    index.build(df.select("section_id", "ord", fields.alias("text")), str(tmp_path))
    found = index.load(spark, str(tmp_path))
    assert {r.term: r.df for r in index.frequencies(found).collect()} == {"recovery": 1, "backup": 1, "steps": 1, "restore": 2, "everything": 2, "twice": 1, "now": 1}
    query = spark.createDataFrame([(0, "restore", 1.0), (1, "backup", 1.0)], "query_id int, term string, weight double")
    best = index.search(found, query, 1).collect()
    assert sorted((r.query_id, r.section_id) for r in best) == [(0, 2), (1, 1)]
    assert index.exists(spark, str(tmp_path)) and not index.exists(spark, str(tmp_path / "none"))
