"""Exact integer arithmetic used by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_half_up(part: Column, whole: Column) -> Column:
    """Whole-number percentage, rounded half up, without any floating point.

    Two-digit decimal division rounds half up before scaling by 100; doing it
    in integers gives the same figure on any engine.
    """
    return F.when(
        whole != 0, F.call_function("div", part * 200 + whole, whole * 2).cast("int")
    )
