"""Message ingestion: validate, store versions, log manifests and metadata.

The store is a log of accepted versions on shared storage.  Every micro-batch
writes its own ``batch_id`` folder with overwrite semantics, so a batch that
runs twice leaves one copy; "newest wins" is decided by version when the store
is read, never by arrival order.  Work per batch is proportional to the batch,
not to the size of the store; ``compact`` folds finished batches together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallystone.functions.topics import message_family, qualify_topic, topic_collection, topic_database
from tallystone.operators import compare, envelope
from tallystone.operators.versions import latest_version_per_id
from tallystone.session import finished_numbers, materialise
from tallystone.sources.sinks import manifest_line
from tallystone.streaming import state as bucketed

RECORD_SCHEMA = (
    "topic string, id string, version bigint, sequence bigint, record_type string, database string, "
    "collection string, timestamp_created_from string, body string"
)
KEYS = ["topic", "id"]
ORDER = ["version", "sequence"]
STORE_BUCKETS = 16
METADATA_SCHEMA = "hbase_id string, hbase_timestamp bigint, topic_name string, reconciled_result int, reconciled_timestamp timestamp"
METADATA_KEYS = ["hbase_id", "hbase_timestamp", "topic_name"]


@dataclass(frozen=True)
class Layout:
    """Folders of one ingestion job."""

    root: str

    @property
    def store(self) -> str:
        return f"{self.root}/store"

    @property
    def manifest(self) -> str:
        return f"{self.root}/manifest"

    @property
    def metadata(self) -> str:
        return f"{self.root}/metadata"

    @property
    def dlq(self) -> str:
        return f"{self.root}/dlq"

    @property
    def compacted(self) -> str:
        return f"{self.root}/compacted"

    @property
    def reconciled(self) -> str:
        return f"{self.root}/reconciled"

    @property
    def open(self) -> str:
        return f"{self.root}/open"

    @property
    def covered(self) -> str:
        return f"{self.root}/covered"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def _put(df: DataFrame, path: str, batch_id: int, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch_id={batch_id}")


def _store_id(id_col: Column) -> Column:
    """A record id as metadata rows have it."""
    return F.replace(id_col, F.lit(" "), F.lit(""))


def _store_bucket(topic: Column, store_id: Column) -> Column:
    """Folder of a key in every batch of the store, so that a lookup opens only the folders of its keys."""
    return F.pmod(F.xxhash64(topic, store_id), F.lit(STORE_BUCKETS)).cast("int")


def split_batch(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted records and dead letters of one batch of ``sequence, topic, value``."""
    read = envelope.read_messages(batch)
    return (
        envelope.accepted(read, extra=("sequence",)),
        envelope.dead_letters(read, extra=("sequence", "topic")),
    )


def write_batch(layout: Layout) -> Callable[[DataFrame, int], None]:
    """Sink of the ingestion stream: store, manifest, metadata and dead letters.

    The parsed batch feeds four outputs, so it is kept for the batch's duration.
    The source's limit per trigger bounds it; a lost executor only recomputes its
    own partitions.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        read = envelope.read_messages(batch).persist()
        try:
            records = envelope.accepted(read, extra=("sequence",))
            # one row per key and version leaves the batch; repeats of a hot key collapse here
            unique = latest_version_per_id(records, [*KEYS, "version"], ["sequence"])
            unique = unique.select(*[c.split(" ")[0] for c in RECORD_SCHEMA.split(", ")])
            unique = unique.withColumn("bucket", _store_bucket(F.col("topic"), _store_id(F.col("id"))))
            _put(unique.repartition("bucket"), layout.store, batch_id, "bucket")
            lines = records.select(
                manifest_line(F.col("id"), F.col("version"), F.col("topic")).alias("value"), "sequence"
            )
            _put(lines, layout.manifest, batch_id)
            meta = envelope.metadata_rows(records)
            _put(meta, layout.metadata, batch_id)
            _put(envelope.dead_letters(read, extra=("sequence", "topic")), layout.dlq, batch_id)
        finally:
            read.unpersist()

    return run


def ingest_stream(messages: DataFrame, layout: Layout, available_now: bool = True) -> StreamingQuery:
    """Start the ingestion of a stream of ``sequence, topic, value``."""
    writer = messages.writeStream.foreachBatch(write_batch(layout)).option(
        "checkpointLocation", layout.checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def newest_state(root: str, buckets: int = 64) -> bucketed.State:
    """The newest version of every record in key buckets."""
    return bucketed.State(root, RECORD_SCHEMA, tuple(KEYS), tuple(ORDER), buckets)


def accepted_records(batch: DataFrame) -> DataFrame:
    """Records of the valid messages among ``sequence, topic, value``."""
    records = envelope.accepted(envelope.read_messages(batch), extra=("sequence",))
    return records.select(*[c.split(" ")[0] for c in RECORD_SCHEMA.split(", ")])


def store_versions(
    spark: SparkSession, layout: Layout, after_batch: int | None = None, through_batch: int | None = None, buckets: list[int] | None = None
) -> DataFrame:
    """Stored versions (several batches may hold the same key), optionally of some batches or key buckets only."""
    log = spark.read.schema(RECORD_SCHEMA + ", batch_id bigint, bucket int").parquet(layout.store)
    if after_batch is not None:
        log = log.where(F.col("batch_id") > after_batch)
    if through_batch is not None:
        log = log.where(F.col("batch_id") <= through_batch)
    if buckets is not None:
        log = log.where(F.col("bucket").isin(buckets))
    return log.drop("batch_id", "bucket")


def compacted_through(spark: SparkSession, layout: Layout) -> int | None:
    """Last batch that the newest finished compaction covers."""
    return max(finished_numbers(spark, layout.compacted, "through"), default=None)


def current_state(spark: SparkSession, layout: Layout, through_batch: int | None = None) -> DataFrame:
    """Newest version of every key, from the newest compaction and the batches after it.

    The batches a compaction covers are recorded in its folder's name, so no caller
    has to pass them and none can be skipped or read twice by mistake.
    """
    covered = compacted_through(spark, layout)
    log = store_versions(spark, layout, covered, through_batch)
    if covered is not None:
        log = log.unionByName(spark.read.schema(RECORD_SCHEMA).parquet(f"{layout.compacted}/through={covered}").drop("bucket"))
    return latest_version_per_id(log, KEYS, ORDER)


def compact(spark: SparkSession, layout: Layout, buckets: int = 64, parts: int = 4) -> int | None:
    """Fold the batches since the last compaction into a new one; returns the last batch it covers.

    Clustered by key bucket, each written by ``parts`` tasks. Work follows the last
    compaction and the new batches. Older folders stay until their readers are gone.
    """
    batches, covered = finished_numbers(spark, layout.store, "batch_id"), compacted_through(spark, layout)
    if not batches or batches[-1] == covered:
        return covered
    through = batches[-1]
    state = current_state(spark, layout, through).withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int"))
    salt = F.pmod(F.xxhash64(*KEYS, F.lit(1)), F.lit(parts))
    state.repartition(F.col("bucket"), salt).write.mode("overwrite").partitionBy("bucket").parquet(f"{layout.compacted}/through={through}")
    return through


def _metadata(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], METADATA_SCHEMA)


def reconcile(spark: SparkSession, layout: Layout, at: Column) -> DataFrame:
    """Metadata rows with their reconciliation result against the store.

    Every run leaves three tables: the rows it closed, the rows that are still open, and
    the last batch it has seen. The next run compares

    - open rows with the store's batches since, as older ones did not hold them;
    - new metadata with the store's batches since, which usually hold it;
    - new metadata that is not found there with the older batches, in the key buckets
      of those rows only.

    Closed rows are never read again, except by who reads the result. Earlier results
    keep their time. A run that ends early is repeated from the run before it.
    """
    runs = finished_numbers(spark, layout.covered, "run")
    seen = spark.read.schema("batch_id bigint").parquet(f"{layout.covered}/run={runs[-1]}").first()[0] if runs else -1
    run = runs[-1] + 1 if runs else 0
    batches = [n for n in finished_numbers(spark, layout.metadata, "batch_id") if n > seen]
    through = max(batches, default=seen)
    arrived = _metadata(spark, [f"{layout.metadata}/batch_id={n}" for n in batches])
    waiting = _metadata(spark, [f"{layout.open}/run={runs[-1]}"] if runs else [])

    def against(rows: DataFrame, *store_range) -> DataFrame:
        stored = store_versions(spark, layout, *store_range).select("topic", _store_id(F.col("id")).alias("id"), "version")
        return compare.metadata_reconcile(rows, stored, at)

    closed = F.coalesce("reconciled_result", F.lit(0)) != 0
    if batches:
        first = materialise(against(arrived, seen, through), "reconciled-arrived")
        late = first.where(~closed)
        bucket = _store_bucket(F.col("topic_name"), F.col("hbase_id")).alias("bucket")
        folders = [r.bucket for r in late.select(bucket).distinct().collect()] if runs else []  # at most STORE_BUCKETS
        late = against(late, None, seen, folders) if folders else late
        compared = materialise(against(waiting, seen, through).unionByName(first.where(closed)).unionByName(late), "reconciled")
    else:
        compared = waiting
    compared.where(closed).write.mode("overwrite").parquet(f"{layout.reconciled}/run={run}")
    compared.where(~closed).write.mode("overwrite").parquet(f"{layout.open}/run={run}")
    spark.createDataFrame([(through,)], "batch_id bigint").coalesce(1).write.mode("overwrite").parquet(f"{layout.covered}/run={run}")
    return reconciled(spark, layout)


def reconciled(spark: SparkSession, layout: Layout) -> DataFrame:
    """All metadata rows that runs have seen, with their results: those closed by any run and those the last one left open."""
    runs = finished_numbers(spark, layout.covered, "run")
    folders = [f"{layout.reconciled}/run={n}" for n in runs] + [f"{layout.open}/run={n}" for n in runs[-1:]]
    return _metadata(spark, folders)


def dlq_archive(messages: DataFrame, path: str, checkpoint: str, per_file: int = 0) -> StreamingQuery:
    """Dead-letter topic to Parquet; ``per_file`` messages a file, 0 for no limit."""
    return (
        messages.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", per_file)
        .trigger(availableNow=True)
        .start()
    )


def family_rules(messages: DataFrame) -> DataFrame:
    """Topic and id rules per message family.

    Main messages keep their topic and use the id object; equalities and audit
    messages are keyed by the message id with a fixed topic.
    """
    topic = F.col("topic")
    family = message_family(topic)
    return messages.withColumns(
        {
            "family": family,
            "qualified_topic": F.when(family == "main", qualify_topic(topic)).otherwise(topic),
            "manifest_database": topic_database(topic),
            "manifest_collection": topic_collection(topic),
            "needs_database": family == "main",
        }
    )
