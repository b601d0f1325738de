"""Evaluation of costly expressions exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections refer to but never repeat.

    A plain projection would be inlined: a filter on something derived from a
    parsed document is pushed below the parse and parses the text again for
    every reference.  A one-element ``inline_outer`` is a generator, which the
    optimizer does not push filters on its output through.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline_outer(packed))
