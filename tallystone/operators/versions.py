"""Newest version per key, snapshots, bookmarks and loads against a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.session import materialise

DELETE_TYPE = "MONGO_DELETE"


def latest_version_per_id(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of every key; ``order`` must decide ties (version, then sequence).

    A max over (order, row) is used instead of a ranked window: each task keeps
    one row per key before the shuffle, so a key with very many versions never
    gathers in one place.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*df.columns)


def without_deleted(latest: DataFrame, type_col: str = "record_type") -> DataFrame:
    """Drop keys whose newest version is a removal."""
    kind = F.col(type_col)
    return latest.where(kind.isNull() | (kind != DELETE_TYPE))


def skip_window(df: DataFrame, column: str, earlier: Column | None = None, later: Column | None = None) -> DataFrame:
    """Drop records before ``earlier`` or after ``later``; both bounds optional."""
    out = df
    if earlier is not None:
        out = out.where(F.col(column) >= earlier)
    if later is not None:
        out = out.where(F.col(column) <= later)
    return out


def time_window(df: DataFrame, column: str, start_ms: int, end_ms: int) -> DataFrame:
    """Records whose time lies in the closed range [start, end]."""
    return df.where(F.col(column).between(start_ms, end_ms))


def skip_existing_load(new: DataFrame, store: DataFrame, keys: list[str], order: list[str], skip_existing: bool) -> DataFrame:
    """State of the store after loading ``new``.

    With ``skip_existing`` keys already stored are left alone; otherwise the
    newest version of both wins.  Either way it is one union and one aggregate
    on the keys, so there is no join to skew.
    """
    columns = store.columns
    if not skip_existing:
        return latest_version_per_id(store.unionByName(new.select(*columns)), keys, order)
    ranked = store.withColumn("stored", F.lit(1)).unionByName(
        new.select(*columns).withColumn("stored", F.lit(0))
    )
    return latest_version_per_id(ranked, keys, ["stored", *order]).drop("stored")


def latest_prior_snapshot(runs: DataFrame, default: str) -> DataFrame:
    """Prefix of the newest completed run per product; a default when none has one."""
    usable = (F.col("status") == "COMPLETED") & F.col("prefix").isNotNull()
    newest = F.max(F.when(usable, F.struct("run_date", "prefix")))["prefix"]
    return runs.groupBy("data_product").agg(F.coalesce(newest, F.lit(default)).alias("prefix"))


def bookmark_next_files(files: DataFrame, bookmark: str | None) -> DataFrame:
    """Files newer than the bookmark, in name order semantics."""
    return files if bookmark is None else files.where(F.col("file") > bookmark)


def next_bookmark(files: DataFrame, bookmark: str | None) -> DataFrame:
    """Bookmark after a run: newest processed file, or the old one if none."""
    return files.agg(F.greatest(F.max("file"), F.lit(bookmark)).alias("bookmark"))


def save_bookmarks(processed: DataFrame, path: str) -> None:
    """Append where each collection of ``processed`` (``collection, version``) now ends."""
    processed.groupBy("collection").agg(F.max("version").alias("processed_end")).write.mode("append").parquet(path)


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """``collection, processed_end``: the furthest end saved per collection; none before the first run.

    Bookmarks only move on, so a run that is repeated changes nothing.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = "collection string, processed_end bigint"
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).groupBy("collection").agg(F.max("processed_end").alias("processed_end"))


def incremental_slice(df: DataFrame, bookmarks: DataFrame, upper: Column) -> DataFrame:
    """Rows of each collection with previous end < time <= new end.

    ``bookmarks`` holds ``collection, processed_end`` (one row per collection);
    collections without a bookmark start at 0.  The bookmarks are written first, so
    that their size is known and records are not shuffled on their few collections.
    """
    joined = df.join(materialise(bookmarks, "bookmarks"), "collection", "left")
    previous = F.coalesce("processed_end", F.lit(0))
    return joined.where((F.col("version") > previous) & (F.col("version") <= upper)).drop("processed_end")
