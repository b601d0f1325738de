"""Timestamps and date offsets (session time zone must be UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSXX"
# A year or a day alone is no timestamp.
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,9}(Z|[+-]\d{2}:?\d{2})?$"
MILLIS_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSS"

# Fixed value: version given to records that carry no date at all.
EPOCH_DEFAULT = "1980-01-01T00:00:00.000+0000"


def parse_iso(text: Column) -> Column:
    """ISO text with seconds, a fraction and ``Z``/``+0000``/no suffix to timestamp, else NULL."""
    return F.when(text.rlike(ISO_SHAPE), F.try_to_timestamp(text))


def iso_to_millis(text: Column, minutes: int | Column = 0) -> Column:
    """ISO text, plus optional minutes, as epoch milliseconds."""
    shift = minutes if isinstance(minutes, Column) else F.lit(minutes)
    positive = F.greatest(shift.cast("long"), F.lit(0).cast("long"))
    return F.unix_millis(parse_iso(text)) + positive * 60000


def millis_to_iso(millis: Column, offset: str = "+0000") -> Column:
    """Epoch milliseconds as ISO text with three fraction digits."""
    return F.concat(F.date_format(F.timestamp_millis(millis), MILLIS_PATTERN), F.lit(offset))


def format_iso(ts: Column, offset: str = "+0000") -> Column:
    """Timestamp as ISO text with three fraction digits."""
    return F.concat(F.date_format(ts, MILLIS_PATTERN), F.lit(offset))


def add_millis(ts: Column, millis: Column | int, with_offset: bool = True) -> Column:
    """Timestamp shifted by milliseconds, as ISO text."""
    step = millis if isinstance(millis, Column) else F.lit(millis)
    shifted = F.timestamp_micros(F.unix_micros(ts) + step.cast("long") * 1000)
    return format_iso(shifted, "+0000" if with_offset else "")


def to_zulu(text: Column) -> Column:
    """Any accepted ISO text rewritten with a ``Z`` suffix."""
    return format_iso(parse_iso(text), "Z")


def offset_date(day: Column, days: Column | int | None, months: Column | int | None) -> Column:
    """Days are added first, months second; a month step clamps to the month end."""
    shifted = day if days is None else F.date_add(day, days)
    return shifted if months is None else F.add_months(shifted, months)


def date_to_int(day: Column) -> Column:
    """Date as a yyyymmdd integer."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.day(day)


def int_to_date(value: Column) -> Column:
    """yyyymmdd integer to date; NULL when no such day exists."""
    return F.try_to_date(value.cast("string"), "yyyyMMdd")
