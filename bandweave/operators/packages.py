"""Transfer packages as Markdown: one text a package, made of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

FORMATS = ("md", "pdf", "docx")


def slug(absent: Column, stamp: Column) -> Column:
    """A file name of the absent people's ids and the time of making."""
    who = F.coalesce(F.nullif(F.array_join(absent, "-"), F.lit("")), F.lit("unknown"))
    return text.package_slug(F.concat(F.lit("transfer-package-"), who, F.lit("-"), F.date_format(stamp, "yyyyMMdd-HHmmss")))


def _lines(*parts) -> Column:
    return F.array(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _header(names: Column) -> Column:
    return _lines("# Knowledge Transfer Package", "", F.concat(F.lit("**Absence simulated:** "), names), "",
                  F.concat(F.lit("**Generated:** "), F.date_format("generated_at", "yyyy-MM-dd HH:mm"), F.lit(" UTC")), "", "---", "")


def render_markdown(packages: DataFrame, gaps: DataFrame) -> DataFrame:
    """(package_id, slug, markdown): the header, a sentence of summary, a table of gaps and a section for each.

    packages has package_id, absent_ids, absent_names, generated_at, total (capabilities);
    gaps package_id, gap_no, capability_id, capability, band_before, band_after, score_before, score_after,
    strongest (who is left, or null) and documents, an array of structs of title and
    url. Gaps of one package are put in order of gap_no; a package without gaps says so.
    """
    score = lambda c: F.format_string("%.2f", F.col(c))
    row = F.format_string(
        "| %s (%s) | %s | **%s** | %s | %d |", "capability", "capability_id", "band_before", "band_after", score("score_after"), F.size("documents")
    )
    fell = F.format_string("**%s** — coverage fell from %s (%s) to %s (%s).", "band_after", "band_before", score("score_before"), "band_after", score("score_after"))
    left = F.coalesce(F.concat(F.lit(" Strongest remaining: "), "strongest", F.lit(".")), F.lit(" No remaining coverage."))
    link = lambda d, i: F.concat((i + 1).cast("string"), F.lit(". ["), d["title"], F.lit("]("), d["url"], F.lit(")"))
    listed = F.when(F.size("documents") > 0, F.concat(F.transform("documents", lambda d, i: F.concat(F.lit("#### "), link(d, i))), F.array(F.lit(""))))
    none = _lines("_No documentation matched this capability._", "")
    section = F.concat(
        _lines(F.concat(F.lit("## "), "capability"), "", F.concat(fell, left), "", "### Supporting Documentation", ""), F.coalesce(listed, none), _lines("---", "")
    )
    one = F.struct("gap_no", row.alias("row"), section.alias("section"), F.when(F.size("documents") == 0, F.col("capability")).alias("bare"))
    by = gaps.groupBy("package_id").agg(F.array_sort(F.collect_list(one)).alias("g"))  # at most as many as there are capabilities
    found = packages.join(by, "package_id", "left")
    names = F.coalesce(F.nullif(F.array_join("absent_names", ", "), F.lit("")), F.array_join("absent_ids", ", "))
    n = F.coalesce(F.size("g"), F.lit(0))
    who = F.coalesce(F.nullif(F.array_join("absent_names", ", "), F.lit("")), F.lit("this engineer"))
    safe = F.format_string("All %d capabilities keep MODERATE or better coverage after this absence. No knowledge transfer is required.", "total")
    some = F.format_string("%d of %d capabilities fall to LOW or NONE without %s. The documentation for each one follows.", n, F.col("total"), who)
    bare = F.filter(F.transform("g", lambda g: g["bare"]), lambda b: b.isNotNull())
    warned = F.when(F.size(bare) > 0, _lines(F.concat(F.lit("> **No documentation exists for: "), F.array_join(bare, ", "), F.lit(".**")), ""))
    table = F.concat(
        _lines("### Capabilities Requiring Transfer", "", "| Capability | Before | After | Score | Documents |", "|---|---|---|---|---|"),
        F.transform("g", lambda g: g["row"]), _lines("", "---", ""), F.flatten(F.transform("g", lambda g: g["section"])),
    )
    nothing = F.array().cast("array<string>")
    body = F.when(n == 0, _lines(safe, "")).otherwise(F.concat(_lines(some, ""), F.coalesce(warned, nothing), table))
    whole = F.concat(F.rtrim(F.array_join(F.concat(_header(names), body), "\n"), F.lit("\n ")), F.lit("\n"))
    return found.select("package_id", slug(F.col("absent_ids"), F.col("generated_at")).alias("slug"), whole.alias("markdown"))


def write(rendered: DataFrame, folder: str, formats: tuple[str, ...] = ("md",)) -> DataFrame:
    """Write each package's Markdown below folder and return (slug, format, reason): reason is null for what was written.

    Formats that have no renderer here are named with the reason; an unknown one raises ValueError.
    """
    if unknown := sorted(set(formats) - set(FORMATS)):
        raise ValueError(f"no such format: {', '.join(unknown)}")
    body = F.regexp_replace("markdown", r"\n\z", "")  # the writer ends each text with a line break
    rendered.select("slug", body.alias("value")).repartition("slug").write.mode("append").partitionBy("slug").option("lineSep", "\n").text(folder)
    reason = F.when(F.col("format") != "md", F.concat(F.lit("no renderer for "), F.col("format")))
    wanted = F.explode(F.array(*(F.lit(f) for f in FORMATS if f in formats or f == "md"))).alias("format")
    return rendered.select("slug", wanted).select("slug", "format", reason.alias("reason"))


def written(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, modified, place): the packages below a folder, the newest first; none if there is no folder."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import Window

    try:
        files = spark.read.text(folder, wholetext=True).select("slug", F.col("_metadata.file_modification_time").alias("modified"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "slug string, modified timestamp, place int")
    each = files.groupBy("slug").agg(F.max("modified").alias("modified"))
    return each.withColumn("place", F.row_number().over(Window.orderBy(F.desc("modified"), "slug")))  # a row a package
