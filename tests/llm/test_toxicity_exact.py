"""Sentence scores and the noisy-or against a plain computation, over short and very long texts."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandweave.llm import toxicity
from bandweave.llm.common import SLICE_BYTES, text_buffers, word_hashes

import pyarrow as pa  # isort: skip


def bucket(word):
    return int(word_hashes(*text_buffers(pa.array([word])))[3][0]) % toxicity.BUCKETS


@pytest.fixture(scope="module")
def model():
    known = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), -6.0, 0.02)
    for word, weight in (("vile", 4.0), ("awful", 3.5), ("kind", -2.0)):
        known.weights[bucket(word)] = weight
    return known


def slow(model, text):
    """Score and offending sentences, one sentence at a time."""
    clear, bad, base = math.log1p(-model.leak), [], 1 / (1 + math.exp(-model.bias))
    for m in re.finditer(r"[^.!?\n]+", text):
        words = list(re.finditer(r"[A-Za-z0-9]+", m[0]))
        if words:
            z = sum(float(model.weights[bucket(w[0])]) for w in words if w[0].lower() in ("vile", "awful", "kind")) + model.bias
            p = 1 / (1 + math.exp(-z))
            clear += min(0.0, math.log1p(-p) - math.log1p(-base))
            if p >= toxicity.THRESHOLD:
                bad.append(f"{m.start() + words[0].start()}:{m.start() + words[-1].end()}")
    return 1 - math.exp(clear), ",".join(bad)


def test_scores_match_a_plain_computation(spark, model):
    rng = random.Random(3)
    words = ["vile", "Awful", "kind", "of", "word.", "end!", "x?", "line\n", "and", "so"]
    texts = ["", "vile awful", "...", *(" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(200))]
    filler = "of and so word. " * (SLICE_BYTES // 16 - 10)
    across = filler + "and so " * 40 + "vile " + "of " * 60 + "awful word. and so"
    endless = "of and " * (SLICE_BYTES // 3) + "vile and " + "so " * 1000 + "awful"
    texts += [across, endless, filler * 3]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, offending string")
    got = {r.doc_id: (r.score, r.offending) for r in toxicity.score_documents(df, model).collect()}
    for i, t in enumerate(texts):
        score, bad = slow(model, t)
        assert got[i][1] == bad, i
        assert abs(got[i][0] - score) < 1e-5, i


def test_fit_is_the_same_for_any_order_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["calm", "plain", "text", "vile."] if i % 3 == 0 else ["calm", "plain", "text."], k=20)), int(i % 3 == 0)) for i in range(300)]
    rows += [(900, None, 1), (901, "", 0), (None, "vile vile", 1), (902, "unlabelled", None)]
    kind = "doc_id long, text string, toxic int"
    one = toxicity.fit(spark.createDataFrame(rows, kind))
    other = toxicity.fit(spark.createDataFrame(rows[::-1] + rows[:40], kind).repartition(5, F.col("text")))
    assert np.array_equal(one.weights, other.weights)
    assert (one.bias, one.leak) == (other.bias, other.leak)
    assert one.weights[bucket("vile")] > 1
