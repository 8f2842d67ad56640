"""Tickets of all shapes are read in one pass."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from bandweave.operators import ladders


def test_a_ticket_is_read_in_one_shape_and_one_pass(spark):
    ann, flat = {"displayName": " ", "name": {"x": 1}, "emailAddress": "a@x.org"}, {"key": "PAY-1", "status": "open", "reporter": "rep"}
    rows = [
        (flat | {"fields": "none", "assignee": ann}, ("PAY-1", '{"x":1}', "rep", None, "open")),
        ({"id": 7, "fields": {"assignee": " bo ", "status": {"name": "done"}, "issuetype": {"id": "3"}}}, ("7", "bo", None, '{"id":"3"}', "done")),
        ({"payload": {"key": " ", "id": "P", "fields": {"reporter": {}, "description": "Assigned to Cy. Soon"}}}, ("P", "Cy", None, None, None)),
        ({"status": " ", "fields": {"status": {"name": " "}}, "payload": {"status": {"name": "late"}}}, (None, None, None, None, "late")),
        ([flat], (None,) * 5),
        (None, (None,) * 5),
    ]
    texts = [(k, json.dumps(value, separators=(",", ":"))) for k, (value, _) in enumerate(rows)] + [(9, '{"key": "cut'), (10, None)]
    df = spark.createDataFrame(texts, "k int, payload string").select("k", ladders.ticket_fields(F.col("payload")).alias("f"))
    got = {r.k: (r.f.id, r.f.assignee, r.f.reporter, r.f.type, r.f.status) for r in df.collect()}
    assert got == {k: want for k, (_, want) in enumerate(rows)} | {9: (None,) * 5, 10: (None,) * 5}
    assert not re.search("get_json_object", df._jdf.queryExecution().optimizedPlan().toString())
