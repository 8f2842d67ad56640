"""Toxicity scores with the text among the kept columns, and batches cut by their text."""

from __future__ import annotations

import pyarrow as pa

from bandweave.llm import toxicity
from bandweave.llm.common import table, text_slices


def test_kept_text_passes_once_and_stays_as_it_was(spark, data):
    docs = table(spark, data, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 7 > 0 THEN text END AS text")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, data, "labels")))
    found = {r.doc_id: (r.score, r.text) for r in toxicity.score_documents(docs, model, ("doc_id", "text")).collect()}
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert found == {r.doc_id: (scores[r.doc_id], r.text) for r in docs.collect()}


def test_batches_are_cut_by_their_text():
    texts = ["a" * 700, None, "", "b" * 2500, "c" * 300, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(text_slices(batch, limit=1000))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 1000 for p in parts)
