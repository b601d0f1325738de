"""Comparison of data sets: set equality, containment, lookups and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.payload import canonical_json, mask_fields


def _tally(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides with how often each side holds them.

    One union and one aggregate: a third of all rows being equal is collapsed
    map-side, and NULLs compare equal because they are group keys.
    """
    both = left.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(
        right.withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1))
    )
    return both.groupBy(*left.columns).agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"))


def _shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and is never broadcast.

    What is selected from a parsed message is estimated by the width of the whole parse,
    some forty times too small, so Spark would send millions of keys through the driver.
    """
    return side.hint("merge")


def set_contains(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected rows that do not occur in ``actual`` (empty = contained)."""
    return _tally(expected, actual).where("left_rows > 0 and right_rows = 0").select(*expected.columns)


def id_set_equality(expected: DataFrame, actual: DataFrame, group: list[str]) -> DataFrame:
    """Per group: ids on each side, how many are missing or unexpected, equal or not."""
    return (
        _tally(expected, actual)
        .groupBy(*group)
        .agg(
            F.count_if(F.col("left_rows") > 0).alias("expected_ids"),
            F.count_if(F.col("right_rows") > 0).alias("actual_ids"),
            F.count_if(F.col("right_rows") == 0).alias("missing_ids"),
            F.count_if(F.col("left_rows") == 0).alias("unexpected_ids"),
        )
        .withColumn("equal", (F.col("missing_ids") == 0) & (F.col("unexpected_ids") == 0))
    )


def set_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: distinct rows only left, only right, and whether the sets are equal."""
    return _tally(left, right).agg(
        F.count_if(F.col("right_rows") == 0).alias("only_left"),
        F.count_if(F.col("left_rows") == 0).alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def result_set_verify(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: row counts and rows that differ, counting duplicates on both sides."""
    surplus = F.col("left_rows") - F.col("right_rows")
    return _tally(golden, actual).agg(
        F.coalesce(F.sum("left_rows"), F.lit(0)).alias("golden_rows"),
        F.coalesce(F.sum("right_rows"), F.lit(0)).alias("actual_rows"),
        F.coalesce(F.sum(F.greatest(surplus, F.lit(0))), F.lit(0)).alias("missing_rows"),
        F.coalesce(F.sum(F.greatest(-surplus, F.lit(0))), F.lit(0)).alias("unexpected_rows"),
    ).withColumn("matches", (F.col("missing_rows") == 0) & (F.col("unexpected_rows") == 0))


def snapshot_containment(expected: DataFrame, actual: DataFrame, column: str = "value") -> DataFrame:
    """Expected JSON records with no equal record in ``actual``, key order ignored.

    Records are matched on the SHA-256 digest of their canonical text.  Actual
    records cross the shuffle as digests only; expected ones bring their text
    along, so neither side is read twice.  Text that is no JSON is compared as
    it stands.
    """
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    side = lambda df: df.select(F.coalesce(canonical_json(F.col(column)), F.col(column)).alias("text"))
    nothing = F.lit(None).cast("string").alias("text")
    both = side(expected).select(digest, "text", F.lit(False).alias("stored")).union(
        side(actual).select(digest, nothing, F.lit(True).alias("stored"))
    )
    return (
        both.groupBy("digest")
        .agg(F.max("text").alias(column), F.bool_or("stored").alias("stored"))
        .where(~F.col("stored"))
        .select(column)
    )


def json_sort_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Canonical JSON lines in text order."""
    return df.select(canonical_json(F.col(column)).alias(column)).orderBy(column)


def store_lookup_compare(expected: DataFrame, store: DataFrame, expect_present: bool = True) -> DataFrame:
    """For each expected record: is its key stored, and is it equal after masking.

    ``expected`` and ``store`` have ``topic, id, value``; a store has one row
    per key.  Other columns of ``expected`` pass through.  ``passed`` flips
    when the records must be absent.
    """
    stored = store.select("topic", "id", F.col("value").alias("stored"))
    joined = expected.join(_shuffled(stored), ["topic", "id"], "left")
    found = F.col("stored").isNotNull()
    same = found & F.coalesce(mask_fields(F.col("value")) == mask_fields(F.col("stored")), F.lit(False))
    passed = same if expect_present else ~found
    kept = [c for c in expected.columns if c != "value"]
    return joined.select(*kept, found.alias("found"), same.alias("matches"), passed.alias("passed"))


def dlq_not_in_store(dlq: DataFrame, store: DataFrame, metadata: DataFrame) -> DataFrame:
    """Dead letters found in neither the store nor the metadata (all should be).

    ``dlq``: ``topic, key, sequence``; ``store``: ``topic, id, version`` rows;
    ``metadata``: ``topic_name, hbase_id``, both with ``sequence``.  A letter without
    a key is compared by its NULL key.
    """
    names = ["topic", "key", "sequence"]
    stored = store.select("topic", F.col("id").alias("key"), "sequence")
    noted = metadata.select(F.col("topic_name").alias("topic"), F.col("hbase_id").alias("key"), "sequence")
    held = _shuffled(stored.union(noted).distinct().toDF(*[f"held_{n}" for n in names]))
    same = [dlq[n].eqNullSafe(F.col(f"held_{n}")) for n in names]
    return dlq.join(held, same, "left_anti")


def metadata_lookup(metadata: DataFrame, id_like: str | Column, topic: str | Column, timestamp: Column | None = None) -> DataFrame:
    """Metadata rows of a topic whose id contains the given text, at one version if given."""
    part = id_like if isinstance(id_like, Column) else F.lit(id_like)
    name = topic if isinstance(topic, Column) else F.lit(topic)
    out = metadata.where((F.col("topic_name") == name) & F.contains(F.col("hbase_id"), part))
    return out if timestamp is None else out.where(F.col("hbase_timestamp") == timestamp)


def metadata_reconcile(metadata: DataFrame, store_versions: DataFrame, at: Column) -> DataFrame:
    """Set the result to 1 on rows whose exact version is in the store.

    Rows already reconciled keep their first result, so a rerun only touches
    open rows.  Store keys are reduced to distinct rows first, which both keeps
    the left join one-to-one and collapses hot keys before the shuffle.
    """
    keys = {"hbase_id": "id", "hbase_timestamp": "version", "topic_name": "topic"}
    stored = (
        store_versions.select(*[F.col(v).alias(k) for k, v in keys.items()])
        .distinct()
        .withColumn("in_store", F.lit(True))
    )
    joined = metadata.join(_shuffled(stored), list(keys), "left")
    newly = (F.col("reconciled_result") == 0) & F.coalesce("in_store", F.lit(False))
    return joined.select(
        *keys,
        F.when(newly, 1).otherwise(F.col("reconciled_result")).alias("reconciled_result"),
        F.when(newly, at).otherwise(F.col("reconciled_timestamp")).alias("reconciled_timestamp"),
    )


def distinct_pairs(df: DataFrame) -> DataFrame:
    """Distinct (database, collection) pairs."""
    return df.select("database", "collection").distinct()


