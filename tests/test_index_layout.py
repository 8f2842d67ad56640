"""How the index is laid out: each block whole in one file, so that a section's scores are summed where they are read."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from bandweave.operators import index


def test_a_block_stands_in_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"word{k}" for k in range(40)], k=rng.randint(0, 12))) for _ in range(300)]
    rows = [(k, k, t) for k, t in enumerate(texts)] + [(1000, 3, "word1 tie"), (1001, 301, None)]
    index.build(spark.createDataFrame(rows, "section_id int, ord long, text string").repartition(7), str(tmp_path))
    found = index.load(spark, str(tmp_path))
    files = found.blocks.select("block", F.input_file_name().alias("file")).distinct().groupBy("block").count()
    assert {r["count"] for r in files.collect()} == {1}
    wanted = {}
    for section, ord_, t in rows:
        words = set((t or "").split())
        for w in words:
            wanted.setdefault((w, ord_ // 8), []).append((ord_, section, len(words)))
    got = {(r.term, r.block): (r.n, r.shortest, [tuple(p) for p in r.postings]) for r in found.blocks.collect()}
    assert got == {k: (len(v), min(p[2] for p in v), sorted(v)) for k, v in wanted.items()}
    filled = [len(set(t.split())) for _, _, t in rows if t]
    assert [tuple(r) for r in found.statistics.collect()] == [(len(filled), sum(filled) / len(filled))]


def test_an_empty_corpus_has_an_index(spark, tmp_path):
    index.build(spark.createDataFrame([], "section_id string, ord long, text string"), str(tmp_path))
    found = index.load(spark, str(tmp_path))
    query = spark.createDataFrame([(0, "word", 1.0)], "query_id int, term string, weight double")
    assert found.statistics.first().n == 0 and index.search(found, query, 3).count() == 0
