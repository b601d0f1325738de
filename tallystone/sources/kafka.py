"""Kafka source and sink; a file-backed topic stands in where there is no broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SCHEMA = "topic string, key string, value string"


def kafka_stream(
    spark: SparkSession, servers: str, topics: str, starting: str = "earliest", per_trigger: int = 5_000_000
) -> DataFrame:
    """Stream of ``topic, key, value, offset`` from a broker (needs the Kafka connector).

    A micro-batch takes at most ``per_trigger`` messages; the rest waits for the next.
    """
    stream = (
        spark.readStream.format("kafka")
        .option("maxOffsetsPerTrigger", per_trigger)
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("startingOffsets", starting)
        .load()
    )
    return stream.select(
        "topic", F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset"
    )


def kafka_write(messages: DataFrame, servers: str) -> None:
    """Publish ``topic, key, value`` rows to a broker (needs the Kafka connector)."""
    messages.select("topic", "key", "value").write.format("kafka").option(
        "kafka.bootstrap.servers", servers
    ).save()


def messages_by_offset(records: DataFrame) -> DataFrame:
    """Messages per topic as the span of offsets over its partitions."""
    spans = records.groupBy("topic", "partition").agg((F.max("offset") - F.min("offset") + 1).alias("n"))
    return spans.groupBy("topic").agg(F.sum("n").alias("messages"))


def file_topic_write(messages: DataFrame, path: str) -> None:
    """Append ``topic, key, value`` rows to a folder used as a topic log."""
    messages.select("topic", "key", "value").write.mode("append").partitionBy("topic").parquet(path)


def file_topic_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Stream over a topic log folder, at most ``per_trigger`` files in a micro-batch."""
    stream = spark.readStream.schema("key string, value string, topic string")
    return stream.option("maxFilesPerTrigger", per_trigger).parquet(path)
