"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only: ids cast to long (null stays null), null texts as empty; other columns cannot clash with an operator's own."""
    return docs.select(
        named(id_col).cast("long").alias("doc_id"),
        F.coalesce(named(text_col), F.lit("")).alias("text"),
    )


def process_cache(kind: str) -> dict:
    """What a Python worker keeps between tasks: vocabularies, open maps and the like.

    One kind at a time: a worker that goes on to another operator lets go of the last one's.
    """
    module = sys.modules.setdefault("_tallystone_process_cache", types.ModuleType("cache"))
    if getattr(module, "kind", None) != kind:
        module.kind, module.held = kind, {}
        give_back()
    return module.held


def filesystem(uri: str):
    """(pyarrow file system, path) of a shared folder, whatever its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def sliced(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` in each; rows stay whole and in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(string_parts(batch.column(column))[0])
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // max_bytes)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0 as int64, bytes as uint8) of a string or binary array without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def mixed(keys: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit keys, so that any bits of them can choose a bucket."""
    keys = keys ^ (keys >> np.uint64(30))
    keys = keys * np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(27)
    keys *= np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def buckets_for(total_bytes: float, spark: SparkSession, each: int = 32 << 20) -> int:
    """How many buckets keep one bucket near ``each`` bytes; never fewer than the shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total_bytes // each) + 1)


def finish_steps(spark: SparkSession) -> None:
    """Let a query's shuffle files go when it ends, as results are kept in the shared folder,
    and send texts to Python in batches that stay small for long texts too."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def give_back() -> None:
    """Return memory that a worker has freed to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
