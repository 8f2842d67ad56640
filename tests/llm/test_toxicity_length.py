"""The score of clean text doesn't grow with its length."""

from __future__ import annotations

import numpy as np

from bandweave.llm import toxicity


def test_long_clean_text_stays_below_the_threshold(spark):
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), -8.7, 0.0025)
    docs = spark.createDataFrame([(1, "All is well here. " * n) for n in (1, 4000, 100_000)], "doc_id long, text string")
    scores = [r.score for r in toxicity.score_documents(docs, model).collect()]
    assert np.allclose(scores, 0.0025)


def test_long_joins_of_clean_documents_stay_below_the_threshold(spark):
    rows = [(i, f"This is a good day {i}. We walk {i % 7}. " + ("you vile scum. " if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    clean = "".join(t for _, t, y in rows if not y) * 200
    docs = spark.createDataFrame([(1, clean), (2, clean + rows[0][1])], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score_documents(docs, model).orderBy("doc_id").collect()] == [0, 1]
