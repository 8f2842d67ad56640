"""Evidence records: the capabilities of a module multiply rows that are distinct already."""

from __future__ import annotations

from bandweave.operators import events


def test_records_are_distinct_before_capabilities_multiply_them(spark, monkeypatch):
    rows = [("e1", "m", "s", "r1"), ("e1", "m", "s", "r1"), ("e2", "m", "s", "r1"), (None, "m", "s", "r2"), (None, "m", "s", "r2"), ("e1", "bare", "s", "r1"), ("e3", None, "s", "r3")]
    found = spark.createDataFrame([(*r, "Demonstrated", "2024-01-01") for r in rows], "employee_id string, module_id string, source string, source_record_id string, provenance_type string, timestamp string")
    modules = spark.createDataFrame([("m", ["a", "b", "a"]), ("m", ["b", "c"]), ("bare", [])], "module_id string, capability_ids array<string>")
    seen, plain = [], type(found).dropDuplicates
    monkeypatch.setattr(type(found), "dropDuplicates", lambda self, *a: (seen.append(self.count()), plain(self, *a))[1])
    got = events.evidence_records(found, modules, fallback="z").select("employee_id", "capability_id", "module_id", "source_ref").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(e, c, "m", r) for e, r in (("e1", "r1"), ("e2", "r1"), (None, "r2")) for c in "abc"] + [("e1", "z", "bare", "r1")], key=str)
    assert seen == [len(rows)]
