"""A payload of the code host is parsed once for all shapes, and normalised rows carry their facts without a join."""

from __future__ import annotations

from bandweave.operators import ladders


def test_payloads_of_three_shapes_are_parsed_once(spark):
    texts = [
        (1, '{"commit": {"message": "fix", "author": {"email": "a@x.org"}}, "files": [{"filename": "a/b.py"}]}'),
        (2, '{"number": 5, "merged": true, "title": "PAY-9", "user": {"login": "bo"}}'),
        (3, '{"_pr_number": 5, "body": "good", "user": {"login": "cy"}}'),
        (4, '{"number": 6, "user": {"login": "bo"}}'),
    ]
    found = ladders.github_rows(spark.createDataFrame(texts, "record_id int, payload string"))
    rows = {(r.record_id, r.record_kind, r.actor, r.role, tuple(r.tokens), r.effort, tuple(r.refs), r.note) for r in found.collect()}
    assert rows == {
        (1, "commit", "a@x.org", "author", ("dir:a", "path:a/b.py"), 0.0, (), "fix"),
        (2, "commit", "bo", "pr_author", (), None, ("PAY-9",), "PAY-9"),
        (3, "pr_review", "cy", "reviewer_substantive", (), None, (), "review on PR #5"),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
