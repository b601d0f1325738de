"""Newest version of every key in key buckets that a micro-batch merges into.

A key's bucket is its hash. A batch reads the newest state of the buckets its keys
fall in, merges, and writes those buckets as a new generation (``bucket=B/batch_id=N``);
other buckets are neither read nor written. The list of buckets a batch has written is
itself a small table and is written last, so it makes the batch visible as a whole. A
batch that runs again starts from the generations before it and writes the same rows to
the same folders, whether its first run ended or not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallystone.operators.versions import latest_version_per_id
from tallystone.session import finished_numbers


@dataclass(frozen=True)
class State:
    """Folders, keys and order of one bucketed state; ``buckets`` must not change later."""

    root: str
    schema: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64

    @property
    def rows(self) -> str:
        return f"{self.root}/rows"

    @property
    def written(self) -> str:
        return f"{self.root}/written"

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).fieldNames()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


def heads(spark: SparkSession, state: State, before: int | None = None) -> dict[int, int]:
    """The batch that wrote each bucket last, of the finished batches (before ``before``); one entry per bucket at most."""
    done = [n for n in finished_numbers(spark, state.written, "batch_id") if before is None or n < before]
    if not done:
        return {}
    # a batch's list carries all buckets known by then, so the last list is enough
    last = spark.read.schema("bucket int, last_batch bigint").parquet(f"{state.written}/batch_id={done[-1]}")
    return {r.bucket: r.last_batch for r in last.collect()}


def _generations(spark: SparkSession, state: State, of: dict[int, int]) -> DataFrame:
    if not of:
        return spark.createDataFrame([], state.schema)
    folders = [f"{state.rows}/bucket={b}/batch_id={n}" for b, n in sorted(of.items())]
    return spark.read.schema(state.schema).parquet(*folders)


def current(spark: SparkSession, state: State) -> DataFrame:
    """Every key with its newest version; a plain scan, as the merge is done when a batch is written."""
    return _generations(spark, state, heads(spark, state))


def merge(spark: SparkSession, state: State, batch: DataFrame, batch_id: int) -> list[int]:
    """Merge a batch of rows into its buckets; returns the buckets written.

    The batch may hold a key several times; newest is decided by ``state.order``.
    An empty batch writes no bucket and is noted all the same.
    """
    rows = latest_version_per_id(batch.select(*state.columns), list(state.keys), list(state.order))
    rows = rows.withColumn("bucket", state.bucket()).persist()
    try:
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        before = heads(spark, state, batch_id)
        held = _generations(spark, state, {b: before[b] for b in touched if b in before}).withColumn("bucket", state.bucket())
        if touched:
            # both sides hold a key once, so buckets are even; dealt by bucket, the merge needs no other shuffle
            both = held.unionByName(rows).repartition(len(touched), "bucket")
            out = latest_version_per_id(both, [*state.keys, "bucket"], list(state.order)).withColumn("batch_id", F.lit(batch_id))
            out.select(*state.columns, "bucket", "batch_id").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket", "batch_id").parquet(state.rows)
    finally:
        rows.unpersist()
    known = sorted((before | dict.fromkeys(touched, batch_id)).items())
    note = spark.createDataFrame(known, "bucket int, last_batch bigint").coalesce(1)
    note.write.mode("overwrite").parquet(f"{state.written}/batch_id={batch_id}")
    return touched


def merging(state: State, prepare: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges what ``prepare`` makes of a batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        merge(batch.sparkSession, state, prepare(batch), batch_id)

    return run


def upsert_stream(messages: DataFrame, state: State, checkpoint: str, prepare: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Keep ``state`` up to date with a stream; stops when all that has arrived is merged."""
    return messages.writeStream.foreachBatch(merging(state, prepare)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire(spark: SparkSession, state: State, keep: int = 2) -> int:
    """Remove generations that no list of the last ``keep`` finished batches names; returns how many.

    Run it when no reader still uses older lists. The lists themselves stay.
    """
    done = finished_numbers(spark, state.written, "batch_id")
    if len(done) <= keep:
        return 0
    named: set[tuple[int, int]] = set()
    for n in done[-keep:]:
        named |= set(heads(spark, state, n + 1).items())
    jvm = spark._jvm.org.apache.hadoop.fs
    removed, root = 0, jvm.Path(state.rows)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in fs.listStatus(root) if fs.exists(root) else []:
        name = bucket.getPath().getName()
        if not name.startswith("bucket="):
            continue
        for generation in fs.listStatus(bucket.getPath()):
            number = int(generation.getPath().getName().split("=")[1])
            if number <= done[-1] and (int(name.split("=")[1]), number) not in named:
                fs.delete(generation.getPath(), True)
                removed += 1
    return removed
