"""Payloads of a code host's interface to flat raw rows; pull requests whose work is still on the default branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(path: str) -> Column:
    return F.get_json_object("payload", path)


def _filled(path: str) -> Column:
    """The value, null where it is empty, zero or false."""
    value = _at(path)
    return F.when(~value.isin("", "0", "false"), value)


def _names(path: str, field: str) -> Column:
    """field of each element of the list at path that has one; an empty list without."""
    items = F.from_json(_at(path), f"array<struct<{field}: string>>")
    return F.coalesce(F.filter(F.transform(items, lambda i: i[field]), lambda v: v != ""), F.array().cast("array<string>"))


def commits(payloads: DataFrame) -> DataFrame:
    """Raw commits; the account's id, else the commit author's name."""
    return payloads.select(
        F.coalesce(_filled("$.author.id"), _at("$.commit.author.name")).alias("author_id"), _at("$.sha").alias("commit_id"),
        _filled("$.commit.author.date").alias("timestamp"), _at("$.commit.message").alias("message"),
        _names("$.files", "filename").alias("files_changed"),
        F.coalesce(_at("$.stats.additions").cast("int"), F.lit(0)).alias("lines_added"),
        F.coalesce(_at("$.stats.deletions").cast("int"), F.lit(0)).alias("lines_deleted"), F.lit(None).cast("string").alias("branch"),
    )


def issues(payloads: DataFrame) -> DataFrame:
    """Raw issues."""
    return payloads.select(
        _at("$.user.id").alias("author_id"), _at("$.id").alias("issue_id"), _at("$.assignee.id").alias("assignee_id"),
        _at("$.created_at").alias("timestamp"), _at("$.title").alias("title"), _at("$.body").alias("description"),
        _at("$.state").alias("status"), _names("$.labels", "name").alias("labels"),
    )


def pull_requests(payloads: DataFrame) -> DataFrame:
    """Raw pull requests; MERGED where a time of merging is given."""
    return payloads.select(
        _at("$.user.id").alias("author_id"), _at("$.id").alias("pr_id"), _at("$.created_at").alias("timestamp"),
        _at("$.title").alias("title"), _at("$.body").alias("description"),
        F.when(_filled("$.merged_at").isNotNull(), "MERGED").otherwise(_at("$.state")).alias("status"),
        F.array().cast("array<string>").alias("files"), _at("$.base.ref").alias("target_branch"),
    )


def reviews(payloads: DataFrame) -> DataFrame:
    """Raw reviews; the body, if there is one, is the only comment."""
    body = _filled("$.body")
    return payloads.select(
        _at("$.user.id").alias("reviewer_id"), _at("$.id").alias("review_id"), _at("$.pull_request_number").alias("pr_id"),
        _at("$.submitted_at").alias("timestamp"), _at("$.state").alias("state"),
        F.when(body.isNotNull(), F.array(body)).otherwise(F.array().cast("array<string>")).alias("comments"),
    )


def reachable_pulls(pulls: DataFrame, commits: DataFrame) -> DataFrame:
    """Pull requests without a merge commit, or with one among the commits; all of them if there are no commits.

    pulls has merge_sha, commits has sha.
    """
    known = commits.select(F.col("sha").alias("merge_sha")).where("merge_sha <> ''").distinct()
    some = known.limit(1).agg(F.count("*").alias("_some"))
    marked = pulls.join(known.withColumn("_known", F.lit(True)), "merge_sha", "left").crossJoin(F.broadcast(some))  # one row
    return marked.where("_some = 0 OR _known OR coalesce(merge_sha, '') = ''").select(*pulls.columns)


def fixture_kind(native_id) -> Column:
    """Which of the three fixture files a payload goes to, by its native id."""
    pull = F.startswith(native_id, F.lit("pr-"))
    return F.when(pull & F.contains(native_id, F.lit("-review-")), "reviews").when(pull, "pulls").otherwise("commits")


def capture(payloads: DataFrame, path: str) -> None:
    """Write payloads (native_id, payload) as text, one folder a kind, to be replayed."""
    kinds = payloads.select(F.coalesce(fixture_kind(F.col("native_id")), F.lit("commits")).alias("kind"), "payload")
    kinds.write.mode("overwrite").partitionBy("kind").text(path)


def replay(spark, path: str) -> DataFrame:
    """(kind, payload) of what capture() has written."""
    return spark.read.text(path).select("kind", F.col("value").alias("payload"))
