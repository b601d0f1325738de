"""Topic, collection and table naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name shapes that must match the existing topics and files.
TABLE_NAME_PATTERN = r"^(?:\w*\.)?([-\w]+)\.([-\w]+)$"
SYNTHETIC_FILE_PATTERN = r"([\w-]+)\.([\w-]+)\.([0-9]+)\.json\.gz$"

# Topics and key fields per message family.
FAMILY_TOPICS = {
    "kafka_equalities": "data.equality",
    "kafka_audit": "data.businessAudit",
}
ID_FIELD_TOPICS = {
    "citizenid": "db.core.claimant",
    "contractid": "db.core.contract",
    "statementid": "db.core.statement",
}


def short_topic(topic: Column) -> Column:
    """Topic without a leading ``db.``."""
    return F.when(topic.startswith("db."), F.substring(topic, 4, 1 << 30)).otherwise(topic)


def topic_database(topic: Column) -> Column:
    """Database part; NULL when the short name has no dot."""
    short = short_topic(topic)
    return F.when(short.contains("."), F.split_part(short, F.lit("."), F.lit(1)))


def topic_collection(topic: Column) -> Column:
    """Collection part: second component, or the whole short name."""
    short = short_topic(topic)
    return F.when(short.contains("."), F.split_part(short, F.lit("."), F.lit(2))).otherwise(short)


def qualify_topic(topic: Column) -> Column:
    """Drop anything after a pipe and make sure the name has a family prefix."""
    bare = F.split_part(topic, F.lit("|"), F.lit(1))
    return F.when(bare.startswith("db.") | bare.startswith("data."), bare).otherwise(
        F.concat(F.lit("db."), bare)
    )


def topic_to_table_name(topic: Column) -> Column:
    """``namespace:table`` of a topic; NULL when the name has another shape."""
    return F.when(
        topic.rlike(TABLE_NAME_PATTERN),
        F.concat_ws(
            ":",
            F.regexp_extract(topic, TABLE_NAME_PATTERN, 1),
            F.regexp_extract(topic, TABLE_NAME_PATTERN, 2),
        ),
    )


def file_name_to_topic(path: Column) -> Column:
    """Topic of a ``<db>.<collection>.<n>.json.gz`` file; NULL for other files."""
    name = F.substring_index(path, "/", -1)
    return F.when(
        name.rlike("^" + SYNTHETIC_FILE_PATTERN),
        F.concat_ws(
            ".",
            F.lit("db"),
            F.regexp_extract(name, "^" + SYNTHETIC_FILE_PATTERN, 1),
            F.regexp_extract(name, "^" + SYNTHETIC_FILE_PATTERN, 2),
        ),
    )


def topics_of_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Distinct topics named by a listing of files."""
    return (
        files.select(file_name_to_topic(F.col(path_col)).alias("topic"))
        .where("topic is not null")
        .distinct()
    )


def message_family(topic: Column) -> Column:
    """``equalities``, ``audit`` or ``main``."""
    return (
        F.when(topic == FAMILY_TOPICS["kafka_equalities"], "equalities")
        .when(topic == FAMILY_TOPICS["kafka_audit"], "audit")
        .otherwise("main")
    )


def topic_of_id_field(field: Column) -> Column:
    """Topic that holds documents keyed by the given id field."""
    name = F.lower(field)
    out = F.lit(None).cast("string")
    for key, topic in ID_FIELD_TOPICS.items():
        out = F.when(name == key, topic).otherwise(out)
    return out
