"""Line-oriented lists of people: blocks of keys and values, of which the ids and handles are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys whose values stand for a person, in the order in which they are noted; a mail address also does by what stands before its @.
HANDLES = ("full_name", "email", "jira_username", "github_handle", "incident_alias", "deploy_actor")
#: Blanks and quotes that are cut off values.
_BLANK, _QUOTES = " \t\r", "\"'"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of each file; a file is one row before it is split. A missing path gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, line int, text string")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("line", "text"))


def _cut(c: Column, chars: str = _BLANK) -> Column:
    return F.btrim(c, F.lit(chars))


def people(lines: DataFrame) -> DataFrame:
    """(file, block, employee_id, fields): the blocks that have an id and a full name.

    A block begins with a line `- id:`, or `employees:`, and reaches to the next; its other
    lines are keys and values. Of equal keys the last counts; lines without a
    colon, comments and empty values don't.
    """
    text = _cut(F.col("text"))
    rows = lines.select("file", "line", text.alias("text"))
    begins = F.col("text").startswith("- id:") | F.col("text").startswith("employees:")
    block = F.sum(begins.cast("int")).over(Window.partitionBy("file").orderBy("line"))
    rows = rows.withColumn("block", block)
    at = F.instr("text", ":")
    first = F.col("text").startswith("- id:")
    key = F.when(first, "id").otherwise(_cut(F.ltrim(_cut(F.expr("substring(text, 1, instr(text, ':') - 1)")), F.lit("- "))))
    value = _cut(F.expr("substring(text, instr(text, ':') + 1)"))
    value = F.when(first, value).otherwise(_cut(value, _QUOTES))
    kept = rows.where((at > 0) & ~F.col("text").startswith("#") & ~F.col("text").startswith("employees:"))
    pairs = kept.select("file", "block", "line", key.alias("key"), value.alias("value")).where("key <> '' AND value <> ''")
    last = pairs.groupBy("file", "block", "key").agg(F.max_by("value", "line").alias("value"))
    made = last.groupBy("file", "block").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fields"))
    found = made.withColumn("employee_id", _cut(F.col("fields")["id"])).where(F.col("employee_id") != "")
    return found.where(_cut(F.col("fields")["full_name"]) != "").select("file", "block", "employee_id", "fields")


def _last(rows: DataFrame, key: str) -> DataFrame:
    """Of equal keys the one that was noted last: of the later block, then of the later handle."""
    return rows.groupBy(key).agg(F.max_by("value", F.struct("file", "block", "place")).alias("value"))


def names(found: DataFrame) -> DataFrame:
    """(key, name): the full name by id and by id in lower case."""
    name = _cut(F.col("fields")["full_name"])
    ids = F.array(F.col("employee_id"), F.lower("employee_id"))
    rows = found.select("file", "block", name.alias("value"), F.posexplode(ids).alias("place", "key"))
    return _last(rows, "key").withColumnRenamed("value", "name")


def handles(found: DataFrame) -> DataFrame:
    """(handle, employee_id): id, HANDLES and what stands before the @ of the mail address, in lower case."""
    at = lambda k: F.lower(_cut(F.col("fields")[k]))
    mail = at("email")
    local = F.when(mail.contains("@"), F.split(mail, "@")[0])
    given = [F.lower("employee_id"), at("full_name"), mail, local, *(at(k) for k in HANDLES[2:])]
    rows = found.select("file", "block", F.col("employee_id").alias("value"), F.posexplode(F.array(*given)).alias("place", "handle"))
    return _last(rows.where("handle IS NOT NULL AND (handle <> '' OR place = 3)"), "handle").withColumnRenamed("value", "employee_id")
