"""Domain tables derived from the shared test tables.

Every rule here is row-wise, so a binding never adds a shuffle of its own.
The ``%`` rules inject defects and gaps (a line missing on one side, a message
without a field); each table is always read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import dates

ENCRYPTED_KEY = "AQIDAHjkeymaterialkeymaterialkeymaterialAAAA"
AMOUNT_KEY = "0123456789abcdef"


# Declared schemas: no footer is read while a plan is being built, and zone-less
# timestamps are taken as UTC instants by the scan itself, so filters on them
# still reach the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp"
    ),
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# --- manifests ------------------------------------------------------------


def _manifest_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("k"),
        key.cast("string").alias("id"),
        F.unix_millis("o_orderdate").alias("timestamp"),
        F.when(key % 97 == 0, "db_x")
        .otherwise(F.concat(F.lit("db_"), F.lower("o_orderstatus")))
        .alias("database"),
        F.col("o_orderpriority").alias("collection"),
    )


def import_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without every tenth key, one whole collection and one whole database."""
    kinds = F.array(*[F.lit(t) for t in ("MONGO_INSERT", "MONGO_UPDATE", "MONGO_DELETE", "MONGO_IMPORT", "test_update")])
    base = _manifest_base(spark, sf_dir)
    kept = base.where(
        "k % 10 <> 3 and not (database = 'db_p' and collection = '5-LOW') and database <> 'db_o'"
    )
    return kept.select(
        "id",
        "timestamp",
        "database",
        "collection",
        F.lit("import").alias("source"),
        F.lit("HDI").alias("component"),
        F.col("id").alias("original_id"),
        F.get(kinds, (F.col("k") % 5).cast("int")).alias("type"),
    )


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with shifted timestamps, other gaps and some ``$oid`` ids."""
    base = _manifest_base(spark, sf_dir)
    kept = base.where(
        "k % 7 <> 2 and not (database = 'db_f' and collection = '1-URGENT') and database <> 'db_x'"
    )
    shift = F.when(F.col("k") % 11 == 0, 1000).when(F.col("k") % 11 == 1, -1000).otherwise(0)
    wrapped = F.concat(F.lit('{""$oid"": ""'), F.col("id"), F.lit('""}'))
    return kept.select(
        F.when(F.col("k") % 13 == 0, wrapped).otherwise(F.col("id")).alias("id"),
        (F.col("timestamp") + shift).alias("timestamp"),
        "database",
        "collection",
        F.lit("export").alias("source"),
        F.when(F.col("k") % 3 == 0, "HDI").otherwise("K2HB").alias("component"),
        F.col("id").alias("original_id"),
        F.when(F.col("k") % 17 == 0, F.lit(None).cast("string"))
        .when(F.col("k") % 2 == 0, "MONGO_INSERT")
        .otherwise("test_insert")
        .alias("type"),
    )


# --- message envelopes ----------------------------------------------------


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON message per event: ``event_id, topic, value``.

    Defects by ``event_id % 50``: 1 no db, 2 no collection, 3 no dbObject,
    4 broken JSON, 5 no last-modified, 6 neither date, 7 plain dbObject,
    8 no encrypted key, 9 empty key, 10 wrong key.
    """
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 50
    stamp = dates.format_iso(F.col("ts"))
    created = F.lit("2015-03-20T12:23:25.183+0000")
    opt = lambda keep, *parts: F.when(keep, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])).otherwise("")
    key_text = F.when(kind == 9, "").when(kind == 10, "foobar").otherwise(ENCRYPTED_KEY)
    value = F.concat(
        F.lit('{"traceId":"trace-'), F.col("event_id").cast("string"),
        F.lit('","unitOfWorkId":"unit-'), F.col("user_id").cast("string"),
        F.lit('","@type":"V4","version":"core-1","timestamp":"'), stamp,
        F.lit('","message":{"@type":"'),
        F.when(F.col("event_id") % 9 == 0, "MONGO_DELETE").otherwise("MONGO_UPDATE"),
        F.lit('"'),
        opt(kind != 2, ',"collection":"', F.col("event_type"), '"'),
        opt(kind != 1, ',"db":"events"'),
        F.lit(',"_id":{"userId": "'), F.col("user_id").cast("string"), F.lit('"}'),
        opt(~kind.isin(5, 6), ',"_lastModifiedDateTime":"', stamp, '"'),
        opt(kind != 6, ',"createdDateTime":"', created, '"'),
        F.lit(',"encryption":{"encryptionKeyId":"key-1"'),
        opt(kind != 8, ',"encryptedEncryptionKey":"', key_text, '"'),
        F.lit("}"),
        F.when(kind == 3, "")
        .when(kind == 7, F.concat(F.lit(',"dbObject":'), F.col("props")))
        .otherwise(F.concat(F.lit(',"dbObject":"'), F.base64(F.col("props").cast("binary")), F.lit('"'))),
        F.lit("}}"),
        F.when(kind == 4, "}").otherwise(""),
    )
    return e.select(
        "event_id",
        F.concat(F.lit("db.events."), F.col("event_type")).alias("topic"),
        value.alias("value"),
    )


# --- historic records -----------------------------------------------------


def historic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One historic JSON record per order: ``k, record``.

    Shapes by ``k % 8``: 0 plain, 1 string date, 2 ``$oid`` id, 3 id with an
    embedded date, 4 no last-modified, 5 neither date, 6 removed, 7 archived.
    """
    o = table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 8
    stamp = F.concat(F.date_format("o_orderdate", dates.MILLIS_PATTERN), F.lit("Z"))
    key = F.col("o_orderkey").cast("string")
    cat = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    id_json = (
        F.when(kind == 2, cat('{"$oid": "', key, '"}'))
        .when(kind == 3, cat('{"orderId":"', key, '","createdDateTime":{"$date":"', stamp, '"}}'))
        .otherwise(cat('{"orderId":"', key, '"}'))
    )
    body = cat(
        '{"_id":', id_json,
        F.when(kind.isin(0, 1), ',"@type":"E2E_IMPORT"').otherwise(""),
        ',"status":"', F.col("o_orderstatus"), '"',
        F.when(kind == 5, "").otherwise(',"createdDateTime":{"$date":"2015-03-20T12:23:25.183Z"}'),
        F.when(kind.isin(4, 5), "")
        .when(kind == 1, cat(',"_lastModifiedDateTime":"', stamp, '"'))
        .otherwise(cat(',"_lastModifiedDateTime":{"$date":"', stamp, '"}')),
        "}",
    )
    outer = lambda word: cat(
        '{"_id":{"$oid":"outer"},"_', word, '":', body, ',"_', word, 'DateTime":{"$date":"', stamp, '"}}'
    )
    record = F.when(kind == 6, outer("removed")).when(kind == 7, outer("archived")).otherwise(body)
    return o.select(F.col("o_orderkey").alias("k"), record.alias("record"))


# --- claimant documents ---------------------------------------------------


def claimants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.struct(F.concat(F.lit("c-"), F.col("c_custkey")).alias("citizenId")).alias("_id"),
        F.col("c_name").alias("nino"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract documents with a people array and seven monthly periods."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    start = lambda i: F.add_months(month, i - 1)
    periods = F.transform(
        F.sequence(F.lit(1), F.lit(7)),
        lambda i: F.struct(
            F.concat_ws("-", F.lit("ap"), F.col("o_orderkey"), i).alias("assessmentPeriodId"),
            dates.date_to_int(start(i)).alias("startDate"),
            dates.date_to_int(F.last_day(start(i))).alias("endDate"),
        ),
    )
    day = dates.date_to_int(F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select(
        F.struct(F.concat(F.lit("k-"), F.col("o_orderkey")).alias("contractId")).alias("_id"),
        F.array(F.concat(F.lit("c-"), F.col("o_custkey"))).alias("people"),
        F.when(F.col("o_orderstatus") == "F", day).alias("closedDate"),
        F.struct(F.when(F.col("o_orderkey") % 10 == 0, day).alias("suspensionDate")).alias("claimSuspension"),
        periods.alias("assessmentPeriods"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement document per line item, pointing at a period of its contract."""
    return table(spark, sf_dir, "lineitem").select(
        F.struct(
            F.concat_ws("-", F.lit("s"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("statementId")
        ).alias("_id"),
        F.struct(
            F.concat_ws("-", F.lit("ap"), "l_orderkey", "l_linenumber").alias("assessmentPeriodId"),
            F.concat(F.lit("k-"), F.col("l_orderkey")).alias("contractId"),
        ).alias("assessmentPeriod"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("takeHomePay"),
        F.when(F.col("l_returnflag") == "R", "MANDATORY_RECONSIDERATION").otherwise("CALCULATED").alias("type"),
        F.unix_millis("l_shipdate").alias("lastModified"),
        F.col("l_quantity").cast("int").alias("version"),
    )
