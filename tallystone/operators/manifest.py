"""Matching of import and export manifests.

Both manifests are reduced in ONE aggregate over their union, keyed by
database, collection and normalised id.  That costs a single shuffle, the
map-side partial aggregate collapses repeated lines of a hot id before anything
moves, and the shuffle key contains the id so a dominant collection is spread
over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.session import materialise
from tallystone.functions.ids import manifest_match_id, manifest_output_id

KEYS = ("database", "collection", "match_id")

# Fixed value: component that marks an exported line as coming from a data load.
DATA_LOAD_COMPONENT = "HDI"

MATCHED_COLUMNS = (
    "id", "database", "collection",
    "import_timestamp", "import_source", "import_component", "import_type",
    "export_timestamp", "export_source", "export_component", "export_type",
    "earliest_timestamp", "latest_timestamp", "earliest_manifest",
)
COUNT_COLUMNS = (
    "database_collection", "database", "collection",
    "imported_count", "exported_count",
    "exported_count_from_data_load", "exported_count_from_streaming_feed",
    "missing_imported_count", "missing_exported_count",
    "mismatched_timestamps_earlier_in_import_count",
    "mismatched_timestamps_earlier_in_export_count",
    "latest_import_timestamp", "earliest_import_timestamp",
    "latest_export_timestamp", "earliest_export_timestamp",
)


def cutoff_window(manifest: DataFrame, start_ms: int | None, end_ms: int | None, margin_minutes: int = 0) -> DataFrame:
    """Lines with start <= timestamp <= end + margin; either bound may be open."""
    out = manifest
    if start_ms is not None:
        out = out.where(F.col("timestamp") >= start_ms)
    if end_ms is not None:
        out = out.where(F.col("timestamp") <= end_ms + margin_minutes * 60_000)
    return out


def _from_load() -> Column:
    return F.coalesce(F.col("component") == DATA_LOAD_COMPONENT, F.lit(False))


def _lines(imports: DataFrame, exports: DataFrame, *columns: str) -> DataFrame:
    side = lambda df, name: df.select(
        F.lit(name).alias("side"),
        "database",
        "collection",
        manifest_match_id(F.col("id")).alias("match_id"),
        "timestamp",
        "component",
        *columns,
    )
    return side(imports, "imp").unionByName(side(exports, "exp"))


def _newest_line(side: str) -> Column:
    """Newest line of one side; structs compare field by field, so ties are settled."""
    line = F.struct("timestamp", _from_load().alias("loaded"), "component", "type", "source", "id")
    return F.max(F.when(F.col("side") == side, line)).alias(side)


def _newest_stamp(side: str) -> Column:
    """Timestamp and load flag of the newest line in one number.

    The pair orders exactly as the first two fields of :func:`_newest_line`, and a
    fixed-width buffer lets Spark use a hash aggregate without any sort.
    """
    stamp = F.col("timestamp") * 2 + _from_load().cast("long")
    return F.max(F.when(F.col("side") == side, stamp)).alias(side)


def match_manifests(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Full outer match: one row per (database, collection, id) with both sides.

    A side holding an id more than once is represented by its newest line.
    ``earliest_manifest`` is NULL when both sides carry the same timestamp.
    """
    pairs = _lines(imports, exports, "type", "source", "id").groupBy(*KEYS).agg(
        _newest_line("imp"), _newest_line("exp")
    )
    return _both_sides(pairs)


def _both_sides(pairs: DataFrame) -> DataFrame:
    """Columns of a match from ``database, collection`` and the newest lines ``imp`` and ``exp``."""
    imp, exp = F.col("imp.timestamp"), F.col("exp.timestamp")
    return pairs.select(
        F.coalesce(
            manifest_output_id(F.col("imp.id")), manifest_output_id(F.col("exp.id"))
        ).alias("id"),
        "database",
        "collection",
        imp.alias("import_timestamp"),
        F.col("imp.source").alias("import_source"),
        F.col("imp.component").alias("import_component"),
        F.col("imp.type").alias("import_type"),
        exp.alias("export_timestamp"),
        F.col("exp.source").alias("export_source"),
        F.col("exp.component").alias("export_component"),
        F.col("exp.type").alias("export_type"),
        F.least(imp, exp).alias("earliest_timestamp"),
        F.greatest(imp, exp).alias("latest_timestamp"),
        F.when(exp.isNull() | (imp < exp), "import")
        .when(imp.isNull() | (exp < imp), "export")
        .alias("earliest_manifest"),
    )


def match_for_counts(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """The columns of :func:`match_manifests` that counting needs, and no others."""
    pairs = _lines(imports, exports).groupBy(*KEYS).agg(_newest_stamp("imp"), _newest_stamp("exp"))
    return pairs.select(
        "database",
        "collection",
        F.shiftright("imp", 1).alias("import_timestamp"),
        F.shiftright("exp", 1).alias("export_timestamp"),
        (F.col("exp") % 2 != 0).alias("export_from_load"),
    )


KEPT_KEYS = ["database_key", "collection_key", "id_key"]


def newest_lines(manifest: DataFrame, buckets: int) -> DataFrame:
    """Newest line of every (database, collection, id), dealt to ``buckets`` partitions by key.

    The key columns are never null: a missing value is an empty text, others start with ``=``.
    """
    key = lambda c, name: F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(name)
    line = F.struct("timestamp", _from_load().alias("loaded"), "component", "type", "source", "id")
    lines = manifest.select(
        key(F.col("database"), "database_key"),
        key(F.col("collection"), "collection_key"),
        key(manifest_match_id(F.col("id")), "id_key"),
        "database",
        "collection",
        line.alias("line"),
    )
    # dealt as the table is bucketed, so neither the aggregate nor a join with it needs a shuffle
    return lines.repartition(buckets, *KEPT_KEYS).groupBy(*KEPT_KEYS).agg(F.first("database").alias("database"), F.first("collection").alias("collection"), F.max("line").alias("line"))


def keep_manifest(manifest: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Keep a manifest's newest lines as an external table, bucketed and sorted by key.

    Comparisons of kept manifests read their buckets side by side: an unchanged manifest is
    shuffled once, when it is kept, however often it is compared.
    """
    rows = newest_lines(manifest, buckets)
    rows.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *KEPT_KEYS).sortBy(*KEPT_KEYS).saveAsTable(table)
    return manifest.sparkSession.table(table)


def match_kept(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """:func:`match_manifests` of two sides from :func:`keep_manifest` or :func:`newest_lines`.

    Both sides have a key once, so the full outer join makes one row per key at most.
    """
    side = lambda df, name: df.select(*KEPT_KEYS, *[F.col(c).alias(f"{name}_{c}") for c in ("database", "collection")], F.col("line").alias(name))
    pairs = side(imports, "imp").join(side(exports, "exp"), KEPT_KEYS, "full")
    either = lambda c: F.coalesce(f"imp_{c}", f"exp_{c}").alias(c)
    return _both_sides(pairs.select(either("database"), either("collection"), "imp", "exp"))


def match_for_types(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Per (database, collection, id): which sides hold it and the type of their newest lines."""
    line = F.struct("timestamp", _from_load().alias("loaded"), "component", "type")
    newest = lambda side: F.max(F.when(F.col("side") == side, line)).alias(side)
    pairs = _lines(imports, exports, "type").groupBy(*KEYS).agg(newest("imp"), newest("exp"))
    return pairs.select(
        "database",
        "collection",
        F.col("imp").isNotNull().alias("imported"),
        F.col("exp").isNotNull().alias("exported"),
        F.col("imp.type").alias("import_type"),
        F.col("exp.type").alias("export_type"),
    )


def collection_counts(matched: DataFrame) -> DataFrame:
    """Per database and collection: totals, gaps, mismatches and time ranges.

    All buffers are fixed-width, so this is a hash aggregate whose partial step
    leaves one row per collection and task.
    """
    imp, exp = F.col("import_timestamp"), F.col("export_timestamp")
    if "export_from_load" in matched.columns:
        loaded = F.col("export_from_load")
    else:
        loaded = F.coalesce(F.col("export_component") == DATA_LOAD_COMPONENT, F.lit(False))
    return (
        matched.groupBy("database", "collection")
        .agg(
            F.count(imp).alias("imported_count"),
            F.count(exp).alias("exported_count"),
            F.count_if(exp.isNotNull() & loaded).alias("exported_count_from_data_load"),
            F.count_if(exp.isNotNull() & ~loaded).alias(
                "exported_count_from_streaming_feed"
            ),
            F.count_if(imp.isNull()).alias("missing_imported_count"),
            F.count_if(exp.isNull()).alias("missing_exported_count"),
            F.count_if(imp < exp).alias("mismatched_timestamps_earlier_in_import_count"),
            F.count_if(exp < imp).alias("mismatched_timestamps_earlier_in_export_count"),
            F.max(imp).alias("latest_import_timestamp"),
            F.min(imp).alias("earliest_import_timestamp"),
            F.max(exp).alias("latest_export_timestamp"),
            F.min(exp).alias("earliest_export_timestamp"),
        )
        .withColumn("database_collection", F.concat_ws(".", "database", "collection"))
        .select(*COUNT_COLUMNS)
    )


def collections_of(manifest: DataFrame) -> DataFrame:
    """Distinct (database, collection) pairs of a manifest; a two-column scan.

    Written once, so its size is known when the joins on it are planned: a list of
    usual size is broadcast and no record-sized input is shuffled on its few values.
    """
    return materialise(manifest.select("database", "collection").distinct(), "collections")


def missing_exports(matched: DataFrame, export_collections: DataFrame | None = None) -> DataFrame:
    """Imported ids without an export, in collections that have some export.

    Collections missing as a whole are reported separately.  The collection
    list is a written table of known size, joined without a hint.
    """
    if export_collections is None:
        export_collections = collections_of(matched.where("export_timestamp is not null"))
    return (
        matched.where("export_timestamp is null")
        .join(export_collections, ["database", "collection"], "left_semi")
        .select("id", "database", "collection", "import_timestamp", "import_component", "import_type")
    )


def missing_imports(matched: DataFrame, import_collections: DataFrame | None = None) -> DataFrame:
    """Exported ids without an import, in collections that have some import."""
    if import_collections is None:
        import_collections = collections_of(matched.where("import_timestamp is not null"))
    return (
        matched.where("import_timestamp is null")
        .join(import_collections, ["database", "collection"], "left_semi")
        .select("id", "database", "collection", "export_timestamp", "export_component", "export_type")
    )


def _one_sided(present: DataFrame, other: DataFrame) -> DataFrame:
    """Newest line of every id of ``present`` that ``other`` does not hold.

    The other side only contributes its keys, so its lines cross the shuffle
    without their detail columns.
    """
    key = [F.col("database"), F.col("collection"), manifest_match_id(F.col("id")).alias("match_id")]
    line = F.struct("timestamp", _from_load().alias("loaded"), "component", "type", "source", "id")
    nothing = F.lit(None).cast(
        "struct<timestamp:bigint,loaded:boolean,component:string,type:string,source:string,id:string>"
    )
    lines = present.select(*key, line.alias("line"), F.lit(False).alias("other")).union(
        other.select(*key, nothing.alias("line"), F.lit(True).alias("other"))
    )
    return (
        lines.groupBy(*KEYS)
        .agg(F.max("line").alias("line"), F.bool_or("other").alias("other"))
        .where(~F.col("other"))
        .select(
            manifest_output_id(F.col("line.id")).alias("id"),
            "database",
            "collection",
            "line.timestamp",
            "line.component",
            "line.type",
        )
    )


def missing_exports_of(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """:func:`missing_exports` straight from the manifests, for when only this is wanted."""
    return (
        _one_sided(imports, exports)
        .join(collections_of(exports), ["database", "collection"], "left_semi")
        .toDF("database", "collection", "id", "import_timestamp", "import_component", "import_type")
        .select("id", "database", "collection", "import_timestamp", "import_component", "import_type")
    )


def missing_imports_of(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """:func:`missing_imports` straight from the manifests, for when only this is wanted."""
    return (
        _one_sided(exports, imports)
        .join(collections_of(imports), ["database", "collection"], "left_semi")
        .toDF("database", "collection", "id", "export_timestamp", "export_component", "export_type")
        .select("id", "database", "collection", "export_timestamp", "export_component", "export_type")
    )


def mismatched_timestamps(matched: DataFrame) -> DataFrame:
    """Ids on both sides whose timestamps differ."""
    return matched.where("import_timestamp <> export_timestamp").select(*MATCHED_COLUMNS)
