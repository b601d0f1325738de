"""Record identifiers: plain text, ``{"$oid": …}`` or a JSON object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OID_PATTERN = r'^\s*\{\s*"\$oid"\s*:\s*"([^"]*)"\s*\}\s*$'
OID_IN_CSV_PATTERN = r'^\s*\{\s*""\$oid""\s*:\s*""([^"]*)""\s*\}\s*$'


def message_id(value: Column) -> Column:
    """``key`` of a message when present, else its ``message._id``."""
    return F.coalesce(
        F.get_json_object(value, "$.key"), F.get_json_object(value, "$.message._id")
    )


def first_id_value(id_text: Column) -> Column:
    """Value of the first field of an id object; a plain id is returned as is."""
    fields = F.from_json(id_text, "map<string,string>")
    return F.when(
        id_text.startswith("{"), F.try_element_at(F.map_values(fields), F.lit(1))
    ).otherwise(id_text)


def wrap_id(id_text: Column) -> Column:
    """``{"id": …}`` around the id text, with all spaces removed."""
    return F.replace(F.to_json(F.struct(id_text.alias("id"))), F.lit(" "), F.lit(""))


def qualified_id(id_text: Column, wrapped: bool) -> Column:
    """Id as it appears in streamed manifests and metadata rows."""
    return wrap_id(id_text) if wrapped else F.replace(id_text, F.lit(" "), F.lit(""))


def _bare_oid(text: Column, pattern: str) -> Column:
    # the plain substring test spares almost all ids the regular expression
    wrapped = F.contains(text, F.lit("$oid")) & text.rlike(pattern)
    return F.when(wrapped, F.regexp_extract(text, pattern, 1)).otherwise(text)


def strip_oid(id_text: Column) -> Column:
    """``{"$oid": x}`` becomes ``x``; anything else is unchanged."""
    return _bare_oid(id_text, OID_PATTERN)


def strip_embedded_dates(id_text: Column) -> Column:
    """``{"$date": x}`` values inside an id object become plain ``x``."""
    return F.regexp_replace(id_text, r'\{\s*"\$date"\s*:\s*("[^"]*")\s*\}', "$1")


def strip_mongo_id(id_text: Column) -> Column:
    """Id without any ``$oid`` or ``$date`` wrapper."""
    return strip_embedded_dates(strip_oid(id_text))


def mongo_format_stripped(id_text: Column) -> Column:
    """Whether :func:`strip_mongo_id` changes the id."""
    return strip_mongo_id(id_text) != id_text


def manifest_output_id(raw_id: Column) -> Column:
    """Id shown in reports: the bare object id, else the text of the manifest."""
    return _bare_oid(_bare_oid(raw_id, OID_PATTERN), OID_IN_CSV_PATTERN)


def manifest_match_id(raw_id: Column) -> Column:
    """Id used to match manifests: doubled quotes collapsed, ``$oid`` removed."""
    return strip_oid(F.replace(raw_id, F.lit('""'), F.lit('"')))
