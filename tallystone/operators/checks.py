"""Counts, shapes, file listings, strict CSV loads and status tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_count_check(df: DataFrame, expected: DataFrame | int, name: str) -> DataFrame:
    """One row: actual and expected number of rows and whether they agree."""
    counted = df.agg(F.count("*").alias("actual"))
    if isinstance(expected, int):
        counted = counted.withColumn("expected", F.lit(expected).cast("long"))
    else:
        # both sides are single-row aggregates
        counted = counted.withColumn("_one", F.lit(1)).join(
            F.broadcast(expected.withColumn("_one", F.lit(1))), "_one"
        )
    return counted.select(
        F.lit(name).alias("name"), "actual", "expected", (F.col("actual") == F.col("expected")).alias("passed")
    )


def file_count_check(files: DataFrame, expected: DataFrame, exact: bool = True) -> DataFrame:
    """Files per topic against the expected number, exactly or at least.

    ``files``: ``topic``; ``expected``: ``topic, wanted`` (one row per topic).
    Topics without any file are checked too.
    """
    counted = files.groupBy("topic").agg(F.count("*").alias("n"))
    joined = expected.join(counted, "topic", "left").withColumn("files", F.coalesce("n", F.lit(0)))
    test = (F.col("files") == F.col("wanted")) if exact else (F.col("files") >= F.col("wanted"))
    return joined.select("topic", "files", "wanted", test.alias("passed"))


def table_shape_check(df: DataFrame, declared: list[str], expected_rows: DataFrame | int, partition_columns: int = 1) -> DataFrame:
    """Row count plus number of columns (declared columns and partition columns)."""
    rows = row_count_check(df, expected_rows, "table")
    wanted = len(declared) + partition_columns
    return rows.select(
        F.col("actual").alias("actual_rows"),
        F.col("expected").alias("expected_rows"),
        F.lit(len(df.columns)).alias("actual_columns"),
        F.lit(wanted).alias("expected_columns"),
        (F.col("passed") & F.lit(len(df.columns) == wanted)).alias("passed"),
    )


# --- strict CSV -----------------------------------------------------------


def declared_schema(columns: dict[str, str]) -> T.StructType:
    """Column map ``{name: type}`` as a schema; any type but string is an integer."""
    return T.StructType(
        [T.StructField(n, T.StringType() if t == "string" else T.IntegerType()) for n, t in columns.items()]
    )


def csv_violations(lines: DataFrame, columns: dict[str, str], value: str = "value") -> DataFrame:
    """Violations per file of raw CSV lines: wrong header and rows of another width.

    ``lines`` has ``file, line_no, value``; the smallest line number (any type
    that orders) is the header.
    """
    names = list(columns)
    # separators inside quoted fields do not count
    bare = F.regexp_replace(value, r'"[^"]*+(?:""[^"]*+)*+"', "")
    width = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    head = F.min_by(F.struct(F.col(value).alias("text"), width.alias("width")), "line_no")
    counted = lines.groupBy("file").agg(
        F.count("*").alias("n"),
        F.count_if(width < len(names)).alias("short"),
        F.count_if(width > len(names)).alias("long"),
        head.alias("head"),
    )
    one = lambda test: test.cast("int")
    return counted.select(
        "file",
        (F.col("n") - 1).alias("rows"),
        one(F.col("head.text") != ",".join(names)).cast("long").alias("bad_headers"),
        (F.col("short") - one(F.col("head.width") < len(names))).alias("short_rows"),
        (F.col("long") - one(F.col("head.width") > len(names))).alias("long_rows"),
    ).withColumn(
        "accepted",
        (F.col("bad_headers") == 0) & (F.col("short_rows") == 0) & (F.col("long_rows") == 0),
    )


def read_csv_strict(spark, path: str, columns: dict[str, str]) -> DataFrame:
    """Read declared-column CSV; a wrong header or a row of another width fails the job.

    Columns are not pruned in the parser, so a count or a narrow select sees a
    broken row as a full read does.
    """
    return spark.read.option("columnPruning", "false").csv(
        path,
        schema=declared_schema(columns),
        header=True,
        enforceSchema=False,
        mode="FAILFAST",
    )


# --- status tables --------------------------------------------------------


def status_all_in(statuses: DataFrame, topics: DataFrame, allowed: list[str]) -> DataFrame:
    """Per correlation id: does every topic have a status from the allowed list.

    ``topics``: ``correlation_id, collection`` pairs that must be covered.
    """
    joined = topics.join(
        statuses.select("correlation_id", "collection", "status"), ["correlation_id", "collection"], "left"
    )
    good = F.coalesce(F.col("status").isin(allowed), F.lit(False))
    return joined.groupBy("correlation_id").agg(
        F.count("*").alias("topics"),
        F.count_if(good).alias("matched"),
        F.bool_and(good).alias("all_matched"),
    )


def status_upsert(current: DataFrame, updates: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Latest-wins merge of status updates by key."""
    rest = [c for c in current.columns if c not in keys and c != sequence]
    merged = current.unionByName(updates.select(*current.columns))
    newest = F.max(F.struct(sequence, *rest)).alias("newest")
    return merged.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*current.columns)


def run_metadata_check(runs: DataFrame, today: Column, allowed_steps: list[str], snapshot_type: str) -> DataFrame:
    """Per run row: is it run 1 of today, in an allowed step and of the right type."""
    checks = {
        "is_first_run": F.col("run_id") == 1,
        "is_today": F.col("run_date") == today,
        "step_allowed": F.col("current_step").isin(allowed_steps),
        "type_matches": F.lower("snapshot_type") == snapshot_type.lower(),
    }
    passed = None
    for test in checks.values():
        passed = test if passed is None else passed & test
    return runs.select("*", *[F.coalesce(t, F.lit(False)).alias(n) for n, t in checks.items()],
                       F.coalesce(passed, F.lit(False)).alias("passed"))
