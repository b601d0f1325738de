"""Top-n per group and exact row numbers over large results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.session import materialise


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group.

    The rank filter lets Spark place a group limit before the shuffle, so each
    task ships at most ``n`` rows of a group however large the group is.
    """
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("rn", rank).where(F.col("rn") <= n).drop("rn")


def numbered(df: DataFrame, group: str, order: list[str], name: str = "row_no") -> DataFrame:
    """Exact 1-based row number within ``group`` without one task per group.

    Rows are range-partitioned by (group, order), written once, numbered inside
    each slice and shifted by the sizes of the earlier slices.  Only the
    slice sizes (one row per slice and group) pass through a single window.
    ``order`` should tell rows apart: equal rows always share a slice.
    """
    sliced = materialise(
        df.repartitionByRange(group, *order).withColumn("slice", F.spark_partition_id()), "numbered"
    )
    sizes = sliced.groupBy(group, "slice").agg(F.count("*").alias("slice_rows"))
    before = W.partitionBy(group).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(group).alias("_group"),
        F.col("slice").alias("_slice"),
        F.coalesce(F.sum("slice_rows").over(before), F.lit(0)).alias("shift"),
    )
    # null-safe, so rows without a group are numbered like any other
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("slice") == F.col("_slice"))
    within = F.row_number().over(W.partitionBy(group, "slice").orderBy(*order))
    return (
        sliced.withColumn("within", within)
        .join(offsets, same)
        .withColumn(name, F.col("within") + F.col("shift"))
        .drop("slice", "within", "shift", "_group", "_slice")
    )
