"""Incremental loads: a stream's checkpoint is the bookmark of the files already loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def load_new_files(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, load: int, files_per_batch: int = 1000
) -> StreamingQuery:
    """Append the rows of JSON files below ``source`` that no earlier start has loaded; ends when none is left.

    ``load`` marks the rows of this start. The checkpoint notes the files of every batch
    before it runs and the target's log lists what finished, so a start that fails is
    taken up where it stopped and no row comes twice. ``files_per_batch`` bounds a batch.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return (
        rows.withColumn("load", F.lit(load))
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def loaded(spark: SparkSession, target: str) -> DataFrame:
    """All rows loaded so far, with the load that brought them; none before the first."""
    return spark.read.parquet(target)
