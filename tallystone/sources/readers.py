"""Readers of manifests, JSON, ORC, partitioned folders and file listings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = (
    "id string, timestamp bigint, database string, collection string, "
    "source string, component string, original_id string, type string"
)
NOT_SET = "NOT_SET"


def scan_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """Row-oriented manifests: ``|``-separated, no header.

    Quoted fields are unescaped; unquoted fields keep their doubled quotes.
    The schema is fixed, so nothing is inferred by an extra pass.
    """
    return spark.read.option("columnPruning", "false").csv(
        path, schema=MANIFEST_SCHEMA, sep="|", quote='"', escape='"', header=False, mode="FAILFAST"
    )


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of CSV files: ``file, line_no, value``.

    ``line_no`` orders the lines of a file's first block and puts them before
    all later blocks, which is all that finding the header needs.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("line_no"), "value")


def scan_jsonl_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Gzip JSON lines below ``y=/m=/d=/db=/coll=`` folders, with a ``day`` column.

    A gzip file is read by one task, so writers should keep files small; a
    corrupt archive fails the job.
    """
    schema = "value string, y string, m string, d string, db string, coll string"
    lines = (
        spark.read.schema(schema)
        .option("ignoreCorruptFiles", "false")
        .option("recursiveFileLookup", "false")
        .text(path)
    )
    return lines.select(
        "*", F.make_date(F.col("y").cast("int"), F.col("m").cast("int"), F.col("d").cast("int")).alias("day")
    )


def scan_json_lines_layout(spark: SparkSession, base: str, day: dt.date | str, database: str = "*", collection: str = "*") -> DataFrame:
    """Lines of ``base/yyyy/MM/dd/database/collection/*.jsonl.gz``.

    The folder names are the filter: only matching folders are listed and read.
    """
    if isinstance(day, dt.date):
        day = day.strftime("%Y/%m/%d")
    return spark.read.option("ignoreCorruptFiles", "false").text(f"{base}/{day}/{database}/{collection}/*.jsonl.gz")


def prune_days(df: DataFrame, start: str | None, end: str | None, column: str = "day") -> DataFrame:
    """Inclusive day range on a partition column; ``NOT_SET``/None leaves a side open."""
    out = df
    if start not in (None, NOT_SET):
        out = out.where(F.col(column) >= F.lit(start).cast("date"))
    if end not in (None, NOT_SET):
        out = out.where(F.col(column) <= F.lit(end).cast("date"))
    return out


def prune_ymd(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """As :func:`prune_days` for a ``y/m/d`` layout.

    The bounds are compared with the partition columns themselves, so folders
    outside the range are never opened.
    """
    ymd = F.concat("y", "m", "d")
    out = df
    if start not in (None, NOT_SET):
        out = out.where(ymd >= start.replace("-", ""))
    if end not in (None, NOT_SET):
        out = out.where(ymd <= end.replace("-", ""))
    return out


def scan_partition_day(df: DataFrame, day: str, column: str = "date_str") -> DataFrame:
    """One day of a table partitioned by a text date."""
    return df.where(F.col(column) == day)


def scan_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array: one row per element.

    A multi-line document cannot be split, so one file is one task; many files
    are read in parallel.
    """
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def explode_json_array(df: DataFrame, column: str, element_schema: str) -> DataFrame:
    """One row per element of a JSON array column."""
    parsed = F.from_json(F.col(column), f"array<{element_schema}>")
    return df.withColumn("element", F.explode(parsed)).drop(column)


def scan_orc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """ORC folder with a declared schema; an empty folder gives no rows."""
    return spark.read.schema(schema).orc(path)


def file_listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below a folder: ``path, length``, optionally by a full-match pattern.

    File contents are not read: only metadata columns are selected.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    )
    return files if pattern is None else files.where(F.col("path").rlike(f"^(?:{pattern})$"))


def files_with_content(spark: SparkSession, path: str, pattern: str, strip: bool = True) -> DataFrame:
    """Matching files with their text, optionally without whitespace.

    Meant for small control and result files; large files should be read as lines.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.decode("content", "UTF-8")
    body = F.translate(text, "\r\n\t ", "") if strip else text
    return files.where(F.col("path").rlike(f"^(?:{pattern})$")).select("path", body.alias("content"))


def prefix_size_and_count(files: DataFrame) -> DataFrame:
    """Total bytes, number of files and whether there is any."""
    return files.agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"), F.count("*").alias("files")
    ).withColumn("exists", F.col("files") > 0)


def prefix_sizes(files: DataFrame, prefix: Column) -> DataFrame:
    """Total bytes and number of files below each prefix, from one listing of them all.

    ``prefix`` takes a file's prefix from its ``path``; files it gives NULL for are left
    out, and a prefix without files has no row.
    """
    return (
        files.select(prefix.alias("prefix"), "length").where("prefix is not null")
        .groupBy("prefix").agg(F.sum("length").alias("total_bytes"), F.count("*").alias("files"))
        .withColumn("exists", F.lit(True))
    )
