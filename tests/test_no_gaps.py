"""The context of a gap where an absence leaves none."""

from __future__ import annotations

import pytest

from bandweave.operators import pages
from bandweave.plans import paging


def test_no_gap_gives_no_row(spark, monkeypatch):
    none = spark.createDataFrame([], "capability_id string, after double, modules array<string>, query string")
    monkeypatch.setattr(paging, "_contexts", lambda spark, d: none)
    found = paging.qry14_context(spark, "")
    assert found.columns == none.columns and found.collect() == []
    with pytest.raises(KeyError):
        pages.gap_context(none, "unknown")
