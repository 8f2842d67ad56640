"""Atomic datasets, normalisation with bad records, the world's snapshot, lists of people, names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bandweave.operators import discovery, normalisation, world
from bandweave.sources import blueprint, datasets


def numbers(spark, n):
    return spark.range(n).withColumn("v", F.col("id") * 2)


def test_a_dataset_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "set")
    assert datasets.read(spark, path) is None
    assert datasets.replace(numbers(spark, 5), path) == 5
    old = datasets.read(spark, path)
    assert datasets.replace(numbers(spark, 9), path, expected=9) == 9
    assert (old.count(), datasets.read(spark, path).count()) == (5, 9)  # who reads the old one still can
    datasets.replace(numbers(spark, 0), path)
    assert datasets.read(spark, path).count() == 0
    assert sum(p.name.startswith("v-") for p in (tmp_path / "set").iterdir()) == 2


def test_a_failure_half_way_leaves_the_old_data(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "set")
    datasets.replace(numbers(spark, 5), path)
    bad = numbers(spark, 50).withColumn("v", F.when(F.col("id") == 49, F.raise_error("broken")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        datasets.replace(bad, path)
    with pytest.raises(ValueError, match="7 rows of 8"):
        datasets.replace(numbers(spark, 7), path, expected=8)

    def cut(*_):
        raise OSError("cut off before the rename")

    with monkeypatch.context() as m:
        m.setattr(datasets, "_put", cut)
        with pytest.raises(OSError, match="cut off"):
            datasets.replace(numbers(spark, 6), path)
    assert datasets.read(spark, path).count() == 5
    assert datasets.replace(numbers(spark, 6), path) == 6
    assert datasets.read(spark, path).count() == 6


RECORDS = [
    (1, "github", "c1", '{"commit": {"message": "fix", "author": {"email": "Ann@x.org", "date": "2024-01-01T00:00:00Z"}}, "parents": [{"sha": "a"}]}'),
    (2, "github", "c2", '{"commit": {"message": "fix"'),
    (3, "github", "c3", None),
    (4, "github", "c4", '{"commit": "text", "author": {"login": "x"}}'),
    (5, "incident", "i5", '{"service": {"id": "S1"}, "responder": "ops", "created_at": "2024-01-01T00:00:00Z"}'),
    (6, "jira", "j6", '{"fields": {"assignee": {"accountId": "ann"}, "components": [{"name": "core"}], "resolution": "Done"}}'),
    (7, "jira", "j7", "[]"),
    (8, "other", "o8", "not even looked at"),
    (9, "github", "c9", "{}"),
]


@pytest.fixture
def given(spark):
    known = [("github", "ann@x.org", "E1"), ("jira", "ann", "E1"), ("incident", "ops", "E2")]
    return (
        spark.createDataFrame(RECORDS, "record_id long, source string, native_id string, payload string"),
        spark.createDataFrame(known, "source string, native_id string, employee_id string"),
        spark.createDataFrame([("E2",)], "employee_id string"),
    )


def test_bad_records_stand_beside_the_good(given):
    rows, errors = normalisation.normalised(*given)
    assert {r.record_id: r.error for r in errors.collect()} == {2: "not JSON", 3: "empty payload", 4: "a field of another shape", 7: "not an object"}
    got = {r.record_id: (r.actor, r.role, r.employee_id, r.rung, r.eligible, r.exclusion_reason) for r in rows.collect()}
    assert got == {
        1: ("Ann@x.org", "author", "E1", "email", True, None),
        5: ("ops", "assigned_no_detail", "E2", "exact", False, "bot"),
        6: ("ann", "assignee_at_resolution", "E1", "exact", True, None),
    }


def test_a_second_run_inserts_nothing(spark, given, tmp_path):
    first, second = (normalisation.normalise_into(*given, str(tmp_path)) for _ in range(2))
    assert (first["inserted"], first["skipped"], first["errors"], first["eligible"], first["excluded_bot"]) == (3, 0, 4, 2, 1)
    assert (second["inserted"], second["skipped"]) == (0, 3)
    assert datasets.read(spark, f"{tmp_path}/items").count() == 3
    more = spark.createDataFrame([(10, *RECORDS[0][1:])], given[0].schema)
    third = normalisation.normalise_into(given[0].unionByName(more), *given[1:], str(tmp_path))
    assert (third["inserted"], datasets.read(spark, f"{tmp_path}/items").count()) == (1, 4)
    none = normalisation.normalise_into(given[0].where("false"), *given[1:], str(tmp_path))
    assert (none["rows"], none["errors"]) == (0, 0)


def test_edges_keep_the_weaker_certainty(spark):
    items = spark.createDataFrame(
        [(1, "E1", True, "certain"), (2, "E1", True, "tentative"), (3, None, True, "certain"), (4, "E1", False, "certain"), (5, "E2", True, "certain")],
        "item_id long, employee_id string, eligible boolean, certainty string",
    )
    units = spark.createDataFrame([(i, i * 10) for i in range(1, 6)], "item_id long, unit long")
    members = spark.createDataFrame(
        [(1, 7, "probable", "auto_applied"), (2, 7, "certain", "human_approved"), (3, 7, "certain", "auto_applied"), (4, 7, "certain", "auto_applied"),
         (5, 7, "certain", "pending_review")], "item_id long, node long, certainty string, review_state string")
    below = spark.createDataFrame([(100, 7), (7, 7)], "ancestor long, node long")
    found = world.evidence_edges(items, units, members, below).collect()
    assert sorted((r.item_id, r.capability, r.unit, r.certainty) for r in found) == [
        (1, 7, 10, "probable"), (1, 100, 10, "probable"), (2, 7, 20, "tentative"), (2, 100, 20, "tentative")]


def test_a_world_is_of_one_moment(spark, tmp_path, monkeypatch):
    for name in world.TABLES:
        numbers(spark, 3).write.parquet(f"{tmp_path}/{name}")
    listed, plain = [], world._listing

    def changing(s, folder):
        if len(listed) == 1:  # after the first listing a table gets another file
            numbers(spark, 2).write.mode("append").parquet(f"{tmp_path}/edges")
        listed.append(1)
        return plain(s, folder)

    monkeypatch.setattr(world, "_listing", changing)
    found = world.load_world(spark, str(tmp_path))
    assert len(listed) == 4
    numbers(spark, 4).write.mode("append").parquet(f"{tmp_path}/edges")
    assert found.edges.count() == 5  # what is added later isn't seen
    monkeypatch.setattr(world, "_listing", lambda *_: [listed.append(1) or len(listed)])
    with pytest.raises(RuntimeError, match="keep changing"):
        world.load_world(spark, str(tmp_path))


PEOPLE = """# a list
version: 2
employees:
  - id: E01
    full_name: "Ann Lee"
    email: Ann.Lee@X.org
    jira_username: 'alee'
    incident_alias: shared
    no colon here
    # email: other@x.org
  - id: E02
    full_name:
    github_handle: lost
  - id: E03
    full_name: Bo
    full_name: Bo Chen
    deploy_actor: shared
    url: http://x.org/a:b
  - id:
    full_name: Nobody
"""


def test_lists_of_people(spark, tmp_path):
    (tmp_path / "people.yaml").write_text(PEOPLE)
    found = blueprint.people(blueprint.read_lines(spark, str(tmp_path / "people.yaml")))
    assert {r.employee_id: r.fields.get("url") for r in found.collect()} == {"E01": None, "E03": "http://x.org/a:b"}
    assert {r.key: r.name for r in blueprint.names(found).collect()} == {"E01": "Ann Lee", "e01": "Ann Lee", "E03": "Bo Chen", "e03": "Bo Chen"}
    assert {r.handle: r.employee_id for r in blueprint.handles(found).collect()} == {
        "e01": "E01", "ann lee": "E01", "ann.lee@x.org": "E01", "ann.lee": "E01", "alee": "E01", "e03": "E03", "bo chen": "E03", "shared": "E03"}
    (tmp_path / "empty.yaml").write_text("")
    for path in ("empty.yaml", "missing.yaml"):
        assert blueprint.people(blueprint.read_lines(spark, str(tmp_path / path))).count() == 0


def test_each_name_is_given_once(spark):
    rows = [(1, "Ledger"), (2, "Ledger"), (3, ""), (4, None), (5, "Misc things"), (6, "Capability 3"), (7, " Ledger "), (8, "Capability 8"), (9, "Routing")]
    got = {r.node: (r.name, r.fault) for r in discovery.name_tree(spark.createDataFrame(rows, "node int, name string"), ("misc",)).collect()}
    assert got == {
        1: ("Ledger", None), 2: ("Capability 2", "duplicate among siblings"), 3: ("Capability 3", "length"), 4: ("Capability 4", "length"),
        5: ("Capability 5", "banned word"), 6: ("Capability 6", "name of another"), 7: ("Capability 7", "duplicate among siblings"),
        8: ("Capability 8", None), 9: ("Routing", None)}
