"""Reading exports and submissions, and writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.config import LIST_COLUMNS
from siftwell.operators.tables import last_by_id, normalised

# The columns of the raw export.
EXPORT_COLUMNS = [
    "Record ID", "First Name", "Last Name", "Full Name", "Email", "Phone Number", "Job Title", "Company Name", "Country/Region", "City", "Lead Status", "Lifecycle Stage", "Original Source",
    "Original Source Drill-Down 1", "Contact Owner", "Create Date", "Last Modified Date", "Notes", "Lead Score", "Annual Revenue", "Marketing contact status", "GDPR consent",
]
SUBMISSION = T.StructType([T.StructField(c, T.StringType()) for c in ("form_id", "form_name", "page_url", "submitted_at", "name", "email", "phone", "company", "country", "message")])


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The export as it is: header, quoted fields over several lines, every value a string, a byte-order mark dropped from the first name."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def load_export(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """The normalised export; of rows with one id the last one in the file counts, and they replace existing ones."""
    raw = read_export(spark, path).withColumn("_at", F.monotonically_increasing_id())
    rows = last_by_id(normalised(raw.drop("_at")).withColumn("_at", F.monotonically_increasing_id()), "_at").drop("_at")
    if existing is None:
        return rows
    return rows.unionByName(existing.join(rows.select("id"), "id", "left_anti"), allowMissingColumns=True)


def load_counts(raw: DataFrame) -> DataFrame:
    """One row (rows, loaded, skipped, replaced) of raw export rows: those without a whole-number id are skipped, earlier rows of an id are replaced by its last one."""
    n = normalised(raw).select("id").agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("id").alias("loaded"))
    return raw.agg(F.count(F.lit(1)).alias("rows")).crossJoin(n).select("rows", "loaded", (F.col("rows") - F.col("kept")).alias("skipped"), (F.col("kept") - F.col("loaded")).alias("replaced"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """An array of JSON objects, over any lines, or one object a line; absent keys are null.

    Files whose first mark is a bracket hold one array each and are read whole; all others are split by line, so that
    a large file of JSON lines is read by many tasks. An unreadable line gives a row of nulls.
    """
    heads = spark.read.text(path).withColumn("_file", F.input_file_name()).filter(F.trim("value") != "")
    first = heads.withColumn("_at", F.monotonically_increasing_id()).groupBy("_file").agg(F.min(F.struct("_at", F.substring(F.ltrim("value"), 1, 1).alias("c")))["c"].alias("c"))
    arrays = first.filter("c = '['").select("_file")
    name = F.input_file_name()
    lines = heads.join(arrays, "_file", "left_anti").select(F.from_json("value", SUBMISSION).alias("x")).select("x.*")
    if arrays.isEmpty():
        return lines
    whole = spark.read.schema(SUBMISSION).json(path, multiLine=True).withColumn("_file", name)
    return whole.join(F.broadcast(arrays), "_file", "left_semi").drop("_file").unionByName(lines)


def write_csv(leads: DataFrame, path: str, single_file: bool = False) -> None:
    """The list columns, ordered by id over the files in order of their names, each with a header; single_file makes it one task's work."""
    rows = leads.select(*[c for c in LIST_COLUMNS if c in leads.columns]).orderBy("id")
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").csv(path, header=True)


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_snapshot(leads: DataFrame, path: str) -> None:
    """Parquet in ranges of domain and id, sorted within files: a lookup by domain opens few files, and a domain with a large part of the rows is spread over several."""
    leads.repartitionByRange("domain_root", "id").sortWithinPartitions("domain_root", "id").write.mode("overwrite").parquet(path)
