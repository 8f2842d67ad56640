"""Fill-in-middle: boundaries, forms and round trips against a plain tokenizer; the wavelet matrix against counting."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandweave.llm import middle
from bandweave.llm.common import table
from bandweave.llm.wavelet import BitVector, WaveletMatrix


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_rank_and_select(size):
    rng = np.random.default_rng(size)
    bits, ends = rng.random(size) < 0.4, np.arange(size + 1)
    vector = BitVector(bits)
    assert vector.rank(ends).tolist() == [int(bits[:e].sum()) for e in ends]
    ones = np.flatnonzero(bits)
    assert vector.select(np.arange(len(ones) + 1)).tolist() == [*ones.tolist(), size]
    symbols = rng.integers(0, 8, size).astype(np.uint8)
    matrix = WaveletMatrix(symbols, 3)
    for s in range(8):
        assert matrix.rank(s, ends).tolist() == [int((symbols[:e] == s).sum()) for e in ends]


def slow(doc_id, text):
    text = text or ""
    k = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, z = sorted((h[0] % (len(k) + 1), h[1] % (len(k) + 1)))
    p, m, s = "".join(k[:a]), "".join(k[a:z]), "".join(k[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(k), "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, len(k), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(k), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def result(docs):
    found = middle.fill_in_middle(docs)
    return sorted((tuple(r) for r in found.select("*", middle.restored(F.col("output"), F.col("form"))).collect()), key=str)


def test_whole_table_matches_the_plain_tokenizer(spark, data):
    docs = table(spark, data, "documents")
    assert result(docs) == sorted((slow(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)


def test_hard_rows(spark):
    texts = [None, "", " ", "a", "<P", "P> <S> x", "<<P", "x<", "naïve 北京 🙂 \u0000 a🙂b", "word " * 400_000, "x" * 2_000_000, "é" * 1000, "\r\n\n"]
    rows = [(i, t) for i in (*range(40), None) for t in texts[: 9 + 4 * (i == 1)]] + [(5, "same twice"), (5, "same twice")]
    df = spark.createDataFrame([(i, t, "psm", 3) for i, t in rows], "doc_id long, text string, form string, n int")
    assert result(df) == sorted((slow(i, t) for i, t in rows), key=str)
    assert middle.fill_in_middle(df.where("false")).count() == 0
