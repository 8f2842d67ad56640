"""Sources and sinks that queries can't show: errors, empty tables, round trips."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bandweave.operators import prose
from bandweave.sources import datasets, live, sinks


@pytest.fixture(scope="module")
def config(spark):
    return spark.createDataFrame([("a", "1", None), ("b", "2", "x")], "key string, value string, basis string")


def test_set_value_replaces_and_adds(config):
    found = sinks.set_value(sinks.set_value(config, "a", value="3"), "c", value="4", basis="y")
    assert {tuple(r) for r in found.collect()} == {("a", "3", None), ("b", "2", "x"), ("c", "4", "y")}


def test_value_of_a_missing_key_raises(config):
    assert sinks.value(config, "b") == "2"
    with pytest.raises(KeyError):
        sinks.value(config, "z")


def test_edges_are_validated(spark):
    nodes, edges = spark.createDataFrame([(1,), (2,), (3,)], "n int"), spark.createDataFrame([(1, 2)], "source int, target int")
    assert sinks.add_edge(edges, nodes, 1, 2).count() == 1
    assert sinks.add_edge(edges, nodes, 2, 3).count() == 2
    with pytest.raises(ValueError):
        sinks.add_edge(edges, nodes, 1, 1)
    with pytest.raises(KeyError):
        sinks.add_edge(edges, nodes, 1, 9)
    with pytest.raises(KeyError):
        sinks.remove_edge(edges, 2, 1)
    assert sinks.remove_edge(edges, 1, 2).isEmpty()


def test_write_all_refuses_lost_rows(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_all(spark.range(2), spark.range(3), str(tmp_path / "x"))
    assert datasets.read(spark, str(tmp_path / "x"), "json") is None
    sinks.write_all(spark.range(3), spark.range(3), str(tmp_path / "x"))
    assert datasets.read(spark, str(tmp_path / "x"), "json").count() == 3


def test_reachable_pulls(spark):
    pulls = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "")], "n int, merge_sha string")
    some, none = spark.createDataFrame([("a",), ("a",), (None,)], "sha string"), spark.createDataFrame([], "sha string")
    assert sorted(r.n for r in live.reachable_pulls(pulls, some).collect()) == [1, 3, 4]
    assert sorted(r.n for r in live.reachable_pulls(pulls, none).collect()) == [1, 2, 3, 4]


def test_fixtures_are_captured_and_replayed(spark, tmp_path):
    rows = [("pr-1-review-7", '{"id": 7}'), ("pr-1", '{"id": 1}'), ("abc", '{"sha": "abc"}'), (None, "{}")]
    live.capture(spark.createDataFrame(rows, "native_id string, payload string"), str(tmp_path / "f"))
    found = {tuple(r) for r in live.replay(spark, str(tmp_path / "f")).collect()}
    assert found == {("reviews", '{"id": 7}'), ("pulls", '{"id": 1}'), ("commits", '{"sha": "abc"}'), ("commits", "{}")}


def test_row_prose_leaves_out_bookkeeping(spark):
    rows = [("7", "Title ", " ", ["a", "b"], "open", "2024"), (None, "t", "u", [], "x", "y"), ("8", None, None, None, "x", "y")]
    raw = spark.createDataFrame(rows, "pr_id string, title string, body string, files array<string>, status string, created_at string")
    found = prose.raw_texts({"pull_request": (raw, "pr_id")}).collect()
    assert [(r.kind, r.place, r.ref, r.text) for r in found] == [("pull_request", 0, "7", "Title  ['a', 'b']")]


def test_evidence_takes_its_own_kind_first(spark):
    raw = spark.createDataFrame([("a", 0, "1", "from a"), ("b", 1, "1", "from b"), ("b", 1, "2", "two")], "kind string, place int, ref string, text string")
    rows = spark.createDataFrame([(1, "b", "1"), (2, "issue", "1"), (3, None, "2"), (4, "a", "9"), (5, "a", None)], "i int, source string, ref string")
    assert {tuple(r) for r in prose.evidence_prose(rows, raw, "i").collect()} == {(1, "from b"), (2, "from a"), (3, "two")}
    assert prose.evidence_prose(rows, raw.where(F.lit(False)), "i").isEmpty()
