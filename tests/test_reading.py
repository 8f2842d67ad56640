"""Readers of missing, empty and broken files; packages, records and drill-downs at their edges."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from bandweave.operators import drilldown, packages
from bandweave.sources import files, mapping


def test_missing_and_empty_arrays_are_empty_tables(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "some.json").write_text('[{"issue_id": "I1", "more": 1},\n {"issue_id": "I2"}]')
    read = lambda name: files.read_json_array(spark, str(tmp_path / name), files.RAW["issues"])
    assert [read(n).count() for n in ("empty.json", "missing.json", "some.json")] == [0, 0, 2]
    with pytest.raises(AnalysisException):
        files.read_payloads(spark, str(tmp_path / "missing.json"), "$.id").count()


def test_a_capture_is_preferred_and_may_be_partial(spark, tmp_path):
    for folder, sha in (("captured", "c"), ("generated", "g")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "github_commits.json").write_text(f'[{{"sha": "{sha}1"}}]')
    (tmp_path / "generated" / "github_pulls.json").write_text('[{"number": 5}]')
    both = lambda a: sorted(r.native_id for r in files.read_code_host(spark, str(tmp_path / a), str(tmp_path / "generated")).collect())
    assert both("captured") == ["c1"]
    assert both("none") == ["g1", "pr-5"]


def test_a_taxonomy_needs_its_three_files(spark, tmp_path):
    (tmp_path / "capabilities.json").write_text('[{"id": "C1"}]')
    (tmp_path / "modules.json").write_text('[{"id": "M1", "name": "Core API"}, {"id": "M2", "name": "X", "jira_component": "Pay Flow"}]')
    with pytest.raises(AnalysisException):
        files.read_taxonomy(spark, str(tmp_path))
    (tmp_path / "services.json").write_text("[]")
    found = files.read_taxonomy(spark, str(tmp_path))
    assert [(r.id, r.name, r.description) for r in found["capabilities"].collect()] == [("C1", "C1", "")]
    assert found["services"].count() == 0
    slugs = lambda path: {r.module_id: r.slug for r in files.component_slugs(spark, str(tmp_path / path), found["modules"].select("id", "name")).collect()}
    assert slugs("modules.json") == {"M1": "core-api", "M2": "pay-flow"}
    assert slugs("missing.json") == {"M1": "core-api", "M2": "x"}


@pytest.mark.parametrize("body", ["", "not json", "[]", '{"other": 1}', '{"spaces": {}}', '{"spaces": null}'])
def test_broken_mappings_are_empty(spark, tmp_path, body):
    (tmp_path / "mapping.json").write_text(body)
    assert mapping.load(spark, str(tmp_path / "mapping.json")).count() == 0
    assert mapping.load(spark, str(tmp_path / "missing.json")).count() == 0


def test_a_decision_by_hand_keeps_what_was_known(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"spaces": {"OPS": {"space_name": "Ops", "service_id": "S1", "status": "ambiguous", "score": 2.5, "candidates": ["S1", "S2"]}}}')
    found = mapping.set_manual(mapping.load(spark, str(tmp_path / "m.json")), "OPS", None)
    row = found.first()
    assert (row.space_name, row.service_id, row.status, row.score, row.reasons, row.candidates) == ("Ops", None, "manual", 2.5, ["set manually"], ["S1", "S2"])
    mapping.save(mapping.set_manual(found, "HR", "S3"), str(tmp_path / "kept"))
    assert {r.space_key: r.status for r in mapping.load(spark, str(tmp_path / "kept")).collect()} == {"OPS": "manual", "HR": "manual"}


def test_packages(spark, tmp_path):
    made = spark.createDataFrame([(1, ["E1", "E 2"], [], "2024-01-02 03:04:05", 7)], "package_id int, absent_ids array<string>, absent_names array<string>, generated_at string, total int")
    made = made.withColumn("generated_at", F.col("generated_at").cast("timestamp"))
    gaps = spark.createDataFrame([], "package_id int, gap_no int, capability_id string, capability string, band_before string, band_after string, score_before double, score_after double, strongest string, documents array<struct<title: string, url: string>>")
    row = packages.render_markdown(made, gaps).first()
    assert row.slug == "transfer-package-E1-E_2-20240102-030405"
    assert row.markdown.endswith("All 7 capabilities keep MODERATE or better coverage after this absence. No knowledge transfer is required.\n")
    assert "**Absence simulated:** E1, E 2" in row.markdown
    with pytest.raises(ValueError, match="odt"):
        packages.write(packages.render_markdown(made, gaps), str(tmp_path / "out"), ("md", "odt"))
    assert packages.written(spark, str(tmp_path / "out")).count() == 0
    made_of = packages.write(packages.render_markdown(made, gaps), str(tmp_path / "out"), ("md", "pdf"))
    assert {(r.format, r.reason) for r in made_of.collect()} == {("md", None), ("pdf", "no renderer for pdf")}
    assert [(r.slug, r.place) for r in packages.written(spark, str(tmp_path / "out")).collect()] == [(row.slug, 1)]


def test_an_unknown_record_raises(spark):
    rows = spark.createDataFrame([(1, "x")], "record_id int, payload string")
    assert drilldown.record(rows, 1).first().payload == "x"
    with pytest.raises(KeyError):
        drilldown.record(rows, 2)
