"""Object tags and the database/table named by an object path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tags_subset(subset: Column, superset: Column) -> Column:
    """Whether every key of ``subset`` is in ``superset`` with the same value."""
    return F.forall(
        F.map_entries(subset),
        lambda e: F.coalesce(
            F.try_element_at(superset, e["key"]) == e["value"], F.lit(False)
        ),
    )


def path_parts(path: Column) -> Column:
    """Path components; the folder marker at the end and ``.db`` endings are removed."""
    unmarked = F.when(path.endswith("_$folder$"), F.left(path, F.length(path) - 9)).otherwise(path)
    bare = lambda p: F.when(p.endswith(".db"), F.replace(p, F.lit(".db"), F.lit(""))).otherwise(p)
    return F.transform(F.split(unmarked, "/"), bare)


def part_from_end(parts: Column, n: int) -> Column:
    """n-th component counted from the end (1 = last); NULL when absent."""
    return F.try_element_at(parts, F.lit(-n))
