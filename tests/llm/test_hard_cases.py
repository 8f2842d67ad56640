"""Long, empty, repeated and clashing rows that the operators must take whole."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from test_operators import BASE, slow_removed, slow_spans

from bandweave.llm import pii, suffix_dedup


@pytest.mark.parametrize(
    "text",
    ["0" * 5000 + ".1.1.1", "0" * 9999 + "255.1.1.1 and " + "9" * 10_000 + ".1.1.1", "+" + "1" * 20_000, "4" * 30_000, "a" * 50_000 + "@b.c"],
)
def test_spans_in_long_runs(text):
    found = pii.find_spans(text)
    slow = {k: [m.span() for m in e.finditer(text)] for k, e in BASE.items()}
    slow["ip"] = [(a, z) for a, z in slow["ip"] if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text[a:z].split("."))]
    slow["card"] = slow["phone"] = []
    assert {k: found[k] for k in BASE} == slow


def test_long_runs_are_redacted(spark):
    rows = [(1, "0" * 5000 + ".1.1.1"), (2, None), (3, ""), (3, ""), (4, "mail a@b.cd now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.t) for r in df.select("doc_id", pii.redact_column(F.col("text")).alias("t")).collect() if r.t is not None)
    assert got == [(1, "[IP]"), (3, ""), (3, ""), (4, "mail [EMAIL] now")]
    assert pii.pii_spans(df.where("false")).count() == 0
    assert not any(slow_spans(t)["email"] for _, t in got)


@pytest.mark.parametrize("rows", [[(0, "abc"), (1, "")], [(0, None)], [(None, "x" * 90), (1, "x" * 90)], [(1, "y" * 80), (1, "y" * 80), (2, "y" * 80)]])
def test_repeats_in_small_tables(spark, rows):
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    known = slow_removed([(i, (t or "").encode()) for i, t in rows if i is not None])
    unknown = [(i, *w[1:]) for i, t in rows if i is None for w in slow_removed([(0, t.encode())])]
    assert got == sorted(known + unknown, key=str)
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0


def shuffled_bytes(spark) -> int:
    """Bytes of shuffle files below the folders where this session's block manager keeps them."""
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return sum(os.path.getsize(f"{d}/{x}") for top in dirs for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_"))


def test_repeats_leave_no_shuffle_files_of_texts_behind(spark):
    rows = spark.range(400).selectExpr("id AS doc_id", "concat(repeat(sha2(string(id), 256), 40), repeat(sha2(string(id % 40), 256), 3), repeat(sha2(string(id % 90), 512), 2)) AS text")
    rows.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.local.dir', '/tmp')}/bandweave-test-repeats-{os.getpid()}")
    docs, before = spark.read.parquet(path), shuffled_bytes(spark)
    spans = suffix_dedup.repeated_spans(docs)
    assert spans.where("end > start").count() > 0
    assert shuffled_bytes(spark) - before < 20_000  # the anchors and segments of these 1.1 MB are hundreds of kB
