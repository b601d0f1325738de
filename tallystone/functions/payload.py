"""JSON payloads: canonical form, masking, key removal and record clean-up."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.functions import dates, ids
from tallystone.functions.once import computed_once

# Fields that differ between runs and the text that hides them.
VOLATILE_TOP_LEVEL = ("unitOfWorkId", "timestamp", "traceId", "put_time", "version", "body", "reason")
VOLATILE_IN_MESSAGE = ("encryption", "dbObject")
IGNORED = "ignored value"


def canonical_json(text: Column) -> Column:
    """Same JSON with the keys of every level in sorted order; NULL when invalid."""
    return F.to_json(F.try_parse_json(text))


def strip_whitespace(text: Column) -> Column:
    """Text without newlines, spaces and tabs."""
    return F.translate(text, "\r\n\t ", "")


def dollar_to_d_keys(text: Column) -> Column:
    """Snapshot form of tagged values: ``$date``/``$oid`` keys become ``d_date``/``d_oid``."""
    return F.regexp_replace(text, r'"\$(date|oid)"(\s*:)', '"d_$1"$2')


# --- typed payloads -------------------------------------------------------


def _rebuild(col: Column, dtype: T.StructType, edit) -> Column:
    fields = []
    for field in dtype.fields:
        value = col.getField(field.name)
        edited = edit(field.name, value)
        if edited is None:
            continue
        if edited is value and isinstance(field.dataType, T.StructType):
            edited = _rebuild(value, field.dataType, edit)
        fields.append(edited.alias(field.name))
    if not fields:
        return F.lit(None).cast("struct<>")
    return F.when(col.isNotNull(), F.struct(*fields))


def drop_key(df: DataFrame, column: str, key: str) -> DataFrame:
    """Remove a field at every depth of a struct column; arrays are left alone."""
    edit = lambda name, value: None if name == key else value
    return df.withColumn(column, _rebuild(F.col(column), df.schema[column].dataType, edit))


def replace_value(df: DataFrame, column: str, key: str, new_value: Column) -> DataFrame:
    """Set a field's value at every depth of a struct column."""
    edit = lambda name, value: new_value if name == key else value
    return df.withColumn(column, _rebuild(F.col(column), df.schema[column].dataType, edit))


# --- payloads of unknown shape -------------------------------------------


def _edited(text: Column, key: str, replacement, drop: bool) -> Column:
    # everything the workers need is defined inside, so it travels with the task
    def edit(document):
        if document is None:
            return None
        root = json.loads(document)
        pending = [root]
        while pending:
            node = pending.pop()
            if not isinstance(node, dict):
                continue
            if key in node:
                if drop:
                    del node[key]
                else:
                    node[key] = replacement
            pending.extend(node.values())
        return json.dumps(root, separators=(",", ":"), ensure_ascii=False)

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(edit)

    return run(text)


def json_drop_key(text: Column, key: str) -> Column:
    """As :func:`drop_key`, for JSON text whose shape is not known in advance."""
    return _edited(text, key, None, True)


def json_replace_value(text: Column, key: str, new_value) -> Column:
    """As :func:`replace_value`, for JSON text whose shape is not known in advance."""
    return _edited(text, key, new_value, False)


# --- masking --------------------------------------------------------------


def mask_fields(text: Column) -> Column:
    """Canonical JSON with every volatile field replaced by a constant if present.

    The text is parsed once to a variant and printed once; the first two levels are
    edited as maps of variants, so no schema is needed and untouched values keep
    their JSON. NULL unless the text is one JSON object.
    """
    as_map = "map<string,variant>"
    ignored = F.parse_json(F.lit(json.dumps(IGNORED)))
    in_message = lambda v: F.transform_values(
        v.try_cast(as_map), lambda name, inner: F.when(name.isin(*VOLATILE_IN_MESSAGE), ignored).otherwise(inner)
    )
    masked = F.transform_values(
        F.try_parse_json(text).try_cast(as_map),
        lambda k, v: F.when(k.isin(*VOLATILE_TOP_LEVEL), ignored)
        .when(k == "message", F.coalesce(F.to_variant_object(in_message(v)), v))
        .otherwise(v),
    )
    return F.to_json(F.to_variant_object(masked))


# --- historic records -----------------------------------------------------

# Date fields of a record and the flag each one sets.
DATE_FLAGS = {
    "_lastModifiedDateTime": "last_modified_date_time_was_altered",
    "createdDateTime": "created_date_time_was_altered",
    "_removedDateTime": "removed_date_time_was_altered",
    "_archivedDateTime": "archived_date_time_was_altered",
}


RECORD_SCHEMA = (
    "`@type` string, _id string, _lastModifiedDateTime string, createdDateTime string, "
    "_removedDateTime string, _archivedDateTime string, _removed string, _archived string"
)
TAGGED_DATE = r'^\{\s*"\$date"\s*:\s*"([^"]*)"\s*\}$'


def parse_record(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the known fields of a record, parsed once.

    Objects (tagged dates, ids, wrapped bodies) arrive as compact JSON text.
    """
    return computed_once(df, **{name: F.from_json(column, RECORD_SCHEMA)})


def date_text(raw: Column) -> Column:
    """A date field as text, whether plain or wrapped in ``$date``; empty is NULL."""
    return F.nullif(F.when(raw.startswith("{"), F.regexp_extract(raw, TAGGED_DATE, 1)).otherwise(raw), F.lit(""))


def date_was_wrapped(raw: Column) -> Column:
    """Whether a date field is an object holding ``$date``."""
    return F.coalesce(raw.rlike(TAGGED_DATE), F.lit(False))


def normalise_date(raw: Column) -> Column:
    """A date field in the common form ``…SSS+0000``."""
    return dates.format_iso(dates.parse_iso(date_text(raw)))


def normalise_dates(df: DataFrame, parsed: str) -> DataFrame:
    """Add the four normalised dates of a parsed record and one alteration flag each."""
    out = {name: normalise_date(F.col(parsed)[name]) for name in DATE_FLAGS}
    for name, flag in DATE_FLAGS.items():
        out[flag] = date_was_wrapped(F.col(parsed)[name])
    return df.withColumns(out)


def record_timestamp(last_modified: Column, created: Column) -> Column:
    """Version text of a record: last modified, else created, else the epoch default."""
    return F.coalesce(last_modified, created, F.lit(dates.EPOCH_DEFAULT))


def timestamp_created_from(last_modified: Column, created: Column, wrapped: Column | None = None) -> Column:
    """Name of the field :func:`record_timestamp` was taken from."""
    plain = F.lit("_lastModifiedDateTime")
    used = plain if wrapped is None else F.when(wrapped, "_lastModifiedDateTimeStripped").otherwise(plain)
    return (
        F.when(last_modified.isNotNull(), used)
        .when(created.isNotNull(), F.lit("createdDateTime"))
        .otherwise(F.lit("epoch"))
    )


def unwrap_removed_archived(df: DataFrame, record: str) -> DataFrame:
    """Make a ``_removed``/``_archived`` body the record itself and flag it.

    Adds ``parsed`` (fields of the record after unwrapping) and ``outer`` (fields
    before); only wrapped rows are parsed a second time.
    """
    opened = parse_record(df, record, "outer")
    inside = F.coalesce("outer._removed", "outer._archived")
    opened = computed_once(
        opened.withColumn("inside", inside), inner=F.from_json("inside", RECORD_SCHEMA)
    )
    wrapped = F.col("inside").isNotNull()
    removed = F.col("outer._removed").isNotNull()
    return opened.withColumns(
        {
            record: F.coalesce("inside", record),
            "parsed": F.when(wrapped, F.col("inner")).otherwise(F.col("outer")),
            "historic_removed_record_altered_on_import": removed,
            "historic_archived_record_altered_on_import": wrapped & ~removed,
        }
    ).drop("inside", "inner")


def default_record_type(parsed: Column, unwrapped: Column | None = None) -> Column:
    """``@type`` of the payload, else MONGO_IMPORT; unwrapped bodies are deletes."""
    plain = F.coalesce(parsed["@type"], F.lit("MONGO_IMPORT"))
    return plain if unwrapped is None else F.when(unwrapped, "MONGO_DELETE").otherwise(plain)


def normalise_historic(df: DataFrame, record: str = "record") -> DataFrame:
    """All clean-up steps of a historic record.

    Output: type, id and its flag, last-modified text, where that came from,
    the six other alteration flags and the record body.
    """
    opened = unwrap_removed_archived(df, record)
    parsed, outer = F.col("parsed"), F.col("outer")
    last, created = date_text(parsed["_lastModifiedDateTime"]), date_text(parsed["createdDateTime"])
    last_wrapped = date_was_wrapped(parsed["_lastModifiedDateTime"])
    moved = F.col("historic_removed_record_altered_on_import") | F.col(
        "historic_archived_record_altered_on_import"
    )
    iso = lambda text: dates.format_iso(dates.parse_iso(text))
    # the removal or archive date may sit beside the wrapped body or inside it
    either = lambda name: date_was_wrapped(outer[name]) | date_was_wrapped(parsed[name])
    return opened.withColumns(
        {
            "record_type": default_record_type(parsed, moved),
            "id": ids.strip_mongo_id(parsed["_id"]),
            "mongo_format_stripped_from_id": ids.mongo_format_stripped(parsed["_id"]),
            "last_modified": record_timestamp(iso(last), iso(created)),
            "timestamp_created_from": timestamp_created_from(last, created, last_wrapped),
            # a filled-in last-modified date counts as altered, like an unwrapped one
            "last_modified_date_time_was_altered": last_wrapped | last.isNull(),
            "created_date_time_was_altered": date_was_wrapped(parsed["createdDateTime"]),
            "removed_date_time_was_altered": either("_removedDateTime"),
            "archived_date_time_was_altered": either("_archivedDateTime"),
        }
    ).drop("parsed", "outer")
