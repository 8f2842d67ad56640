"""Datasets that are replaced whole: readers see the old one or the new one, never a part.

A version is written beside the others and counted while it is written; then one
rename puts a small file in place that names the version. Until then, and if
anything fails, readers go on with the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import delete

POINTER = "CURRENT"
#: Text repeats its field names in every row; readers take the codec from the files' names.
TEXT_OPTIONS = {"json": {"compression": "gzip"}}


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it there, over the one that there is."""
    jvm, beside = spark._jvm, f"{path}.{uuid.uuid4().hex}"
    out = _files(spark, beside).create(_path(spark, beside), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    target = context.makeQualified(_path(spark, path))
    context.rename(context.makeQualified(_path(spark, beside)), target, over)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version in place; None if there is none."""
    files, pointer = _files(spark, path), f"{path}/{POINTER}"
    if not files.exists(_path(spark, pointer)):
        return None
    return f"{path}/{spark.read.text(pointer).first().value}"


def read(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """The dataset in place, None before the first was put there. A later replacement doesn't change it, but for its files being dropped."""
    found = current(spark, path)
    return spark.read.format(kind).load(found) if found else None


def replace(df: DataFrame, path: str, kind: str = "parquet", expected: int | None = None) -> int:
    """Put df in place of the dataset and return its number of rows.

    ValueError, and the old one stays, unless it has as many rows as expected; they
    are counted in the one pass that writes them. The version before the last is
    dropped, the last stays for those who read it.
    """
    spark, seen, version = df.sparkSession, Observation(), f"v-{uuid.uuid4().hex}"
    before = current(spark, path)
    target = f"{path}/{version}"
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format(kind).options(**TEXT_OPTIONS.get(kind, {})).save(target)
        n = seen.get["n"]
        if expected is not None and n != expected:
            raise ValueError(f"{n} rows of {expected}")
    except BaseException:
        delete(spark, target)
        raise
    _put(spark, f"{path}/{POINTER}", version)
    keep = {target, before}
    for status in _files(spark, path).listStatus(_path(spark, path)):
        name = status.getPath().getName()
        if name.startswith("v-") and f"{path}/{name}" not in keep:
            delete(spark, f"{path}/{name}")
    return n
