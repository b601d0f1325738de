"""Destinations of collections, topic selection and object tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.session import materialise
from tallystone.functions.tags import part_from_end, path_parts
from tallystone.functions.topics import topic_collection, topic_database

MAX_DB_DEPTH = 4


def destinations(collections: DataFrame) -> DataFrame:
    """``name, destination`` rules as one row per destination with its polarity."""
    each = collections.select("name", F.explode(F.split("destination", ",")).alias("rule"))
    return each.select(
        "name",
        F.regexp_replace("rule", "^!", "").alias("destination"),
        (~F.col("rule").startswith("!")).alias("must_exist"),
    )


def destination_routing(collections: DataFrame, files: DataFrame) -> DataFrame:
    """Per collection and destination: are data and control file where they should be.

    ``files``: ``name, destination, kind`` with kind ``data`` or ``control``.
    An excluded destination must hold neither.
    """
    found = files.groupBy("name", "destination").agg(
        F.bool_or(F.col("kind") == "data").alias("has_data"),
        F.bool_or(F.col("kind") == "control").alias("has_control"),
    )
    joined = destinations(collections).join(found, ["name", "destination"], "left")
    data, control = F.coalesce("has_data", F.lit(False)), F.coalesce("has_control", F.lit(False))
    return joined.select(
        "name",
        "destination",
        "must_exist",
        data.alias("has_data"),
        control.alias("has_control"),
        F.when(F.col("must_exist"), data & control).otherwise(~data & ~control).alias("passed"),
    )


def topic_selection(
    requests: DataFrame, defaults_full: str, defaults_incremental: str, defaults_drift: str
) -> DataFrame:
    """Topics of each request: first non-empty override wins, ``all`` means the default list.

    ``requests``: ``request_id, overrides array<string>, snapshot_type, fallback array<string>``.
    """
    kind = F.lower("snapshot_type")
    default = (
        F.when(kind == "incremental", defaults_incremental)
        .when(kind == "drift_testing_incremental", defaults_drift)
        .otherwise(defaults_full)
    )
    given = F.filter(F.coalesce("overrides", F.array().cast("array<string>")), lambda o: o.isNotNull() & (o != ""))
    first = F.get(given, F.lit(0))
    chosen = F.when(first.isNull(), F.col("fallback")).otherwise(
        F.split(F.when(F.lower(first) == "all", default).otherwise(first), ",")
    )
    return requests.select("request_id", F.explode(chosen).alias("topic"))


def select_by_topic(df: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows whose topic is in the selection; the join strategy is left to run time."""
    return df.join(topics.select("topic").distinct(), "topic", "left_semi")


def lines_of_topics(lines: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows of partitioned ``lines`` (``db``, ``coll``) whose collection a ``db.<database>.<collection>`` topic names.

    The topics are written first, so they are joined by broadcast where they are few, and
    the scan takes its folders from them: collections that no topic names are not opened.
    """
    named = topics.select("topic").distinct().where(F.col("topic").startswith("db."))
    named = materialise(named, "chosen-topics").where(F.col("topic").startswith("db."))
    folders = named.select(topic_database(F.col("topic")).alias("db"), topic_collection(F.col("topic")).alias("coll"))
    return lines.join(folders, ["db", "coll"], "left_semi")


def path_candidates(path: Column) -> Column:
    """(position, database, table) triples a path may stand for, nearest first."""
    parts = path_parts(path)
    triple = lambda n: F.struct(
        F.lit(n).alias("position"),
        part_from_end(parts, n).alias("db"),
        part_from_end(parts, n - 1).alias("table"),
    )
    pairs = F.array(*[triple(n) for n in range(2, MAX_DB_DEPTH + 1)])
    return F.when(F.size(parts) >= 3, F.filter(pairs, lambda p: p["db"].isNotNull()))


def path_to_db_table(paths: DataFrame, databases: DataFrame) -> DataFrame:
    """Database and table named by each path; NULLs when no known database is in it.

    ``paths``: ``path``; ``databases``: ``db``.  The candidates, nearest first, are
    looked up one after the other in the list of databases, a written table of known
    size, and the first known one wins: paths are joined where they are.
    """
    known = materialise(databases.select("db").distinct(), "databases")
    found = paths.select("path", path_candidates(F.col("path")).alias("c"))
    hits = []
    for n in range(MAX_DB_DEPTH - 1):
        side = known.select(F.col("db").alias(f"db_{n}"))
        here = F.get("c", F.lit(n))
        found = found.join(side, here["db"] == F.col(f"db_{n}"), "left")
        hits.append(F.when(F.col(f"db_{n}").isNotNull(), F.struct(here["db"].alias("db"), here["table"].alias("table"))))
    hit = F.coalesce(*hits)
    return found.select("path", hit["db"].alias("db"), hit["table"].alias("table"))


def tag_classification_join(located: DataFrame, classification: DataFrame) -> DataFrame:
    """Tags of each located path: ``pii`` is empty for an unclassified table.

    Paths without a known database have no tags.  ``classification`` has
    ``db, table, pii``.
    """
    unique = materialise(classification.groupBy("db", "table").agg(F.max("pii").alias("pii")), "classes")
    joined = located.join(unique, ["db", "table"], "left")
    tags = F.when(
        F.col("db").isNotNull() & F.col("table").isNotNull(),
        F.create_map(
            F.lit("table"), F.col("table"), F.lit("db"), F.col("db"), F.lit("pii"), F.coalesce("pii", F.lit(""))
        ),
    )
    return joined.select("path", "db", "table", tags.alias("tags"))
