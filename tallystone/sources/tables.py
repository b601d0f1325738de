"""External Parquet tables of the reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COUNTS_DDL = """database_collection string, database string, collection string,
  imported_count bigint, exported_count bigint,
  exported_count_from_data_load bigint, exported_count_from_streaming_feed bigint,
  missing_imported_count bigint, missing_exported_count bigint,
  mismatched_timestamps_earlier_in_import_count bigint,
  mismatched_timestamps_earlier_in_export_count bigint,
  latest_import_timestamp bigint, earliest_import_timestamp bigint,
  latest_export_timestamp bigint, earliest_export_timestamp bigint"""
MISSING_IMPORTS_DDL = """id string, database string, collection string,
  export_timestamp bigint, export_component string, export_type string"""
MISSING_EXPORTS_DDL = """id string, database string, collection string,
  import_timestamp bigint, import_component string, import_type string"""
MATCHED_DDL = """id string, database string, collection string,
  import_timestamp bigint, import_source string, import_component string, import_type string,
  export_timestamp bigint, export_source string, export_component string, export_type string,
  earliest_timestamp bigint, latest_timestamp bigint, earliest_manifest string"""

TABLES = {
    "counts": COUNTS_DDL,
    "missing_imports": MISSING_IMPORTS_DDL,
    "missing_exports": MISSING_EXPORTS_DDL,
    "mismatched": MATCHED_DDL,
}


def qualified_table_name(database: str, base: str, import_source: str | None = None, export_source: str | None = None) -> str:
    """``database.base[_import][_export]`` in lower-case source names."""
    parts = [base] + [s.lower() for s in (import_source, export_source) if s is not None]
    return f"{database}.{'_'.join(parts)}"


def create_external_table(spark: SparkSession, name: str, ddl: str, location: str) -> DataFrame:
    """(Re)create an external Snappy Parquet table over ``location``."""
    folder = location if location.endswith("/") else location + "/"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({ddl}) USING parquet OPTIONS (compression 'snappy') LOCATION '{folder}'"
    )
    return spark.table(name)


def write_table(df: DataFrame, name: str, kind: str, location: str) -> DataFrame:
    """Write one of the four tables and register it over its location."""
    spark = df.sparkSession
    ddl = TABLES[kind]
    columns = spark.createDataFrame([], ddl).columns
    df.select(*columns).write.mode("overwrite").option("compression", "snappy").parquet(location)
    return create_external_table(spark, name, ddl, location)
