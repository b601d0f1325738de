"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions.ids import qualified_id
from tallystone.functions.topics import topic_collection, topic_database
from tallystone.session import scratch_path


def write_report_lines(lines: DataFrame, path: str) -> None:
    """The text of ordered lines, one folder per query type.

    Files are numbered in line order, so the parts of a folder in name order are
    the document.
    """
    lines.select("query_type", F.col("line").alias("value")).write.partitionBy("query_type").text(path)


def written_and_read_report(lines: DataFrame, name: str) -> DataFrame:
    """Write a report document per query type and read its lines back."""
    path = scratch_path(lines.sparkSession, name)
    write_report_lines(lines, path)
    return lines.sparkSession.read.schema("line string, query_type string").text(path).select("query_type", "line")


def manifest_line(id_text: Column, version_ms: Column, topic: Column, wrapped: bool = False) -> Column:
    """Streamed manifest line of an accepted record."""
    quoted = F.concat(F.lit('"'), qualified_id(id_text, wrapped), F.lit('"'))
    return F.concat_ws(
        "|",
        quoted,
        version_ms.cast("string"),
        F.coalesce(topic_database(topic), F.lit("None")),
        topic_collection(topic),
        F.lit("STREAMED"),
        F.lit("K2HB"),
        quoted,
        F.lit("KAFKA_RECORD"),
    )


def write_manifest(lines: DataFrame, path: str) -> None:
    """Manifest lines (column ``value``) as text files."""
    lines.select("value").write.mode("append").text(path)


def write_manifest_csv(manifest: DataFrame, path: str) -> None:
    """A manifest table as delimited text without a header.

    Fields are written as they are: ids already hold doubled quotes.
    """
    cols = ["id", F.col("timestamp").cast("string"), "database", "collection", "source", "component", "original_id"]
    line = F.concat_ws("|", *cols, F.coalesce("type", F.lit("")))
    manifest.select(line.alias("value")).write.text(path)


def _gathered(rows: DataFrame, folders: list[str], files: int) -> DataFrame:
    return rows.repartition(*[F.col(c) for c in folders], F.pmod(F.xxhash64("value"), F.lit(files)))


def write_snapshot(records: DataFrame, path: str, files: int = 4) -> None:
    """JSON lines per export date, snapshot type, database and collection, gzipped.

    ``records`` has ``export_date, snapshot_type, database, collection, value``.
    A folder's rows go to ``files`` tasks by a salt, so there are few files per
    folder and a dominant collection stays spread.
    """
    folders = ["export_date", "snapshot_type", "database", "collection"]
    _gathered(records, folders, files).write.partitionBy(*folders).option("compression", "gzip").mode("append").text(path)


def write_dlq(messages: DataFrame, path: str, one_file_each: bool = False) -> None:
    """Dead-letter messages as Parquet, optionally one file per message."""
    writer = messages.write.mode("append")
    if one_file_each:
        writer = writer.option("maxRecordsPerFile", 1)
    writer.parquet(path)


def write_jsonl_partitioned(records: DataFrame, path: str, files: int = 2) -> None:
    """``day, database, collection, value`` as ``yyyy/MM/dd/db/collection`` gzip lines, ``files`` per folder at most."""
    rows = records.select(
        F.date_format("day", "yyyy").alias("y"),
        F.date_format("day", "MM").alias("m"),
        F.date_format("day", "dd").alias("d"),
        F.col("database").alias("db"),
        F.col("collection").alias("coll"),
        "value",
    )
    folders = ["y", "m", "d", "db", "coll"]
    _gathered(rows, folders, files).write.partitionBy(*folders).option("compression", "gzip").mode("append").text(path)


def write_orc(df: DataFrame, path: str, partition_col: str | None = None) -> None:
    writer = df.write.mode("append")
    if partition_col:
        writer = writer.partitionBy(partition_col)
    writer.orc(path)


def empty_orc(spark: SparkSession, schema: str, path: str) -> None:
    """Initial state: an ORC folder with a schema and no rows."""
    spark.createDataFrame([], schema).write.mode("overwrite").orc(path)


def write_report_documents(lines: DataFrame, path: str) -> None:
    """One text file per query type below ``path/query_type=…``, its lines in report order.

    ``lines`` has ``query_type, query_order, position, line``. A type is written by one task
    that sorts on disk and streams, so the file is whole however long it is; the writer's
    commit renames it into place, and a task that runs again leaves one file.
    """
    types = max(1, lines.select("query_type").distinct().count())
    ordered = lines.repartition(types, "query_type").sortWithinPartitions("query_type", "query_order", "position")
    ordered.select("query_type", "line").write.mode("overwrite").option("compression", "none").partitionBy("query_type").text(path)
