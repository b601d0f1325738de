"""Message envelopes: parsing, validation and the accepted/rejected split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import dates, ids, payload
from tallystone.functions.once import computed_once
from tallystone.functions.topics import message_family

# One envelope followed by an end marker; see with_envelope.
_PARSE_SCHEMA = """array<struct<
  `@type`: string, version: string, timestamp: string, traceId: string, unitOfWorkId: string,
  message: struct<
    `@type`: string, collection: string, db: string, _id: string,
    _lastModifiedDateTime: string, createdDateTime: string, _removedDateTime: string,
    encryption: struct<encryptionKeyId: string, encryptedEncryptionKey: string,
                       initialisationVector: string, keyEncryptionKeyId: string>,
    dbObject: variant>,
  _end: string>>"""

# Reasons written to the dead-letter rows.
INVALID_JSON = "Invalid"
MISSING_DATABASE = "missing database"
MISSING_COLLECTION = "missing collection"
MISSING_OBJECT = "missing dbObject"
PLAIN_OBJECT = "unencrypted dbObject"
MISSING_KEY = "missing encryptedEncryptionKey"
EMPTY_KEY = "empty encryptedEncryptionKey"
WRONG_KEY = "incorrect encryptedEncryptionKey"

# A wrapped data key is base64 text of at least this many characters.
WRAPPED_KEY_PATTERN = r"^[A-Za-z0-9+/]{32,}={0,2}$"


def with_envelope(messages: DataFrame, value: str = "value", name: str = "envelope") -> DataFrame:
    """Add the envelope struct of each message, NULL unless it is one JSON object.

    The JSON readers stop at the end of the first value and would accept
    trailing text.  Parsing ``[value, {"_end": hash}]`` makes them read it all:
    the marker is only found when the value is exactly one document.  The text
    is parsed once for both the check and the fields.
    """
    marker = F.xxhash64(value).cast("string")
    wrapped = F.concat(F.lit("["), F.col(value), F.lit(',{"_end":"'), marker, F.lit('"}]'))
    parsed = computed_once(messages, _parsed=F.from_json(wrapped, _PARSE_SCHEMA), _marker=marker)
    complete = (F.size("_parsed") == 2) & (F.try_element_at("_parsed", F.lit(2))["_end"] == F.col("_marker"))
    envelope = F.when(complete, F.get("_parsed", F.lit(0)))
    return parsed.withColumn(name, envelope).drop("_parsed", "_marker")


def _object_kind(message: Column) -> Column:
    return F.schema_of_variant(message["dbObject"])


def rejection_reason(envelope: Column, topic: Column) -> Column:
    """Why a message goes to the dead-letter queue; NULL when it is accepted.

    Database and collection are only required on the main family.
    """
    message = envelope["message"]
    main = message_family(topic) == "main"
    kind = _object_kind(message)
    return (
        F.when(envelope.isNull(), INVALID_JSON)
        .when(main & message["db"].isNull(), MISSING_DATABASE)
        .when(main & message["collection"].isNull(), MISSING_COLLECTION)
        .when(message["dbObject"].isNull() | (kind == "VOID"), MISSING_OBJECT)
        .when(kind != "STRING", PLAIN_OBJECT)
    )


def key_violation(envelope: Column) -> Column:
    """What is wrong with the wrapped data key; NULL when nothing is."""
    key = envelope["message"]["encryption"]["encryptedEncryptionKey"]
    return (
        F.when(key.isNull(), MISSING_KEY)
        .when(key == "", EMPTY_KEY)
        .when(~key.rlike(WRAPPED_KEY_PATTERN), WRONG_KEY)
    )


def read_messages(messages: DataFrame, value: str = "value", topic: str = "topic") -> DataFrame:
    """Messages with their parsed envelope and rejection reason."""
    parsed = with_envelope(messages, value)
    return parsed.withColumn("reason", rejection_reason(F.col("envelope"), F.col(topic)))


def accepted(read: DataFrame, topic: str = "topic", extra: tuple[str, ...] = ()) -> DataFrame:
    """Accepted messages as store records.

    ``topic, id, version, record_type, database, collection,
    timestamp_created_from, body`` plus any pass-through columns.
    """
    message = F.col("envelope")["message"]
    last = F.nullif(message["_lastModifiedDateTime"], F.lit(""))
    created = F.nullif(message["createdDateTime"], F.lit(""))
    return read.where("reason is null").select(
        *extra,
        F.col(topic).alias("topic"),
        message["_id"].alias("id"),
        F.unix_millis(dates.parse_iso(payload.record_timestamp(last, created))).alias("version"),
        message["@type"].alias("record_type"),
        message["db"].alias("database"),
        message["collection"].alias("collection"),
        payload.timestamp_created_from(last, created).alias("timestamp_created_from"),
        F.try_variant_get(message["dbObject"], "$", "string").alias("body"),
    )


def dead_letters(read: DataFrame, value: str = "value", extra: tuple[str, ...] = ()) -> DataFrame:
    """Rejected messages as ``body, reason, key``."""
    key = F.coalesce(
        F.get_json_object(value, "$.key"), F.col("envelope")["message"]["_id"]
    )
    return read.where("reason is not null").select(
        *extra, F.col(value).alias("body"), "reason", key.alias("key")
    )


def metadata_rows(records: DataFrame, wrapped: bool = False) -> DataFrame:
    """One metadata row per accepted record, not yet reconciled."""
    return records.select(
        ids.qualified_id(F.col("id"), wrapped).alias("hbase_id"),
        F.col("version").alias("hbase_timestamp"),
        F.col("topic").alias("topic_name"),
        F.lit(0).alias("reconciled_result"),
        F.lit(None).cast("timestamp").alias("reconciled_timestamp"),
    )


def _strict_violation() -> Column:
    message = F.col("envelope")["message"]
    return (
        F.when(F.col("envelope").isNull(), INVALID_JSON)
        .when(message["dbObject"].isNull() | (_object_kind(message) == "VOID"), MISSING_OBJECT)
        .otherwise(key_violation(F.col("envelope")))
    )


def strict_violations(messages: DataFrame, value: str = "value") -> DataFrame:
    """Number of messages per reason that must fail a strict load.

    Missing or empty last-modified dates are accepted.
    """
    return (
        with_envelope(messages.select(value), value)
        .select(_strict_violation().alias("violation"))
        .where("violation is not null")
        .groupBy("violation")
        .agg(F.count("*").alias("messages"))
    )


def strict_ingest(messages: DataFrame, value: str = "value") -> DataFrame:
    """Parsed messages; any use of the result, a count too, fails on the first bad message.

    The check is a filter, which no column pruning can take out.
    """
    parsed = with_envelope(messages, value)
    violation = _strict_violation()
    return parsed.where(F.when(violation.isNotNull(), F.raise_error(violation).cast("boolean")).otherwise(True))
