"""JSON datasets are written compressed and read back as they were."""

from __future__ import annotations

from bandweave.sources import datasets


def test_json_datasets_are_compressed(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "repeat('same text ', 20) AS said")
    assert datasets.replace(rows, f"{tmp_path}/out", "json", expected=2000) == 2000
    back = datasets.read(spark, f"{tmp_path}/out", "json")
    assert back.select("id", "said").exceptAll(rows).isEmpty() and back.count() == 2000
    assert sum(f.stat().st_size for f in tmp_path.rglob("part-*")) < 100_000
