"""Data products: flattened views, raw snapshots and the analytical dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import dates
from tallystone.functions.once import computed_once
from tallystone.operators.versions import latest_version_per_id
from tallystone.session import materialise

# Statement type kept by the reconsideration view and its reason.
RECONSIDERATION_TYPE = "MANDATORY_RECONSIDERATION"
RECONSIDERATION_REASON = "MAKE_A_DECISION_MANDATORY_RECONSIDERATION"


def obligation_flatten(documents: DataFrame) -> DataFrame:
    """One row per easement and referral of an obligation document.

    Empty arrays give one row with NULL.  Both arrays are exploded row by row,
    so the step needs no shuffle.
    """
    dated = computed_once(
        documents,
        changed=dates.int_to_date(F.col("statusLastChangedDate")),
        modified=dates.parse_iso(F.col("_lastModifiedDateTime.d_date")),
    )
    return dated.select(
        F.col("_id.youthObligationDetailsId").alias("obligation_id"),
        F.col("claimantId").alias("claimant_id"),
        F.col("changed").alias("status_last_changed_date"),
        F.col("changed").cast("timestamp").alias("status_last_changed_ts"),
        F.col("youthObligationReferrals").alias("referrals"),
        F.col("youthObligationStatus").alias("status"),
        F.col("modified").cast("date").alias("last_modified_date"),
        F.col("modified").alias("last_modified_ts"),
        F.explode_outer("youthObligationEasements").alias("easement"),
    ).select("*", F.explode_outer("referrals").alias("referral")).drop("referrals")


# The amounts of a statement.
STATEMENT_AMOUNTS = (
    "standardAllowanceElement", "housingElement", "housingElementRent", "housingElementServiceCharges",
    "childElement", "disabledChildElement", "childcareElement", "carerElement", "takeHomePay",
    "unaffectedPayElement", "totalReducedForHomePay", "otherIncomeAdjustment", "capitalAdjustment",
    "totalAdjustments", "fraudPenalties", "sanctions", "advances", "deductions", "totalPayment",
)


# Marks of a packed row: below all printable characters, so packed rows sort as their columns do.
_NO_TEXT, _NEXT_TEXT = "\x00", "\x01"


def _packed(df: DataFrame, names: list[str]) -> DataFrame:
    """Text columns as one text, a third as wide while rows are sorted and shuffled; see :func:`_unpacked`.

    A row whose texts hold a mark of its own keeps them in an array.
    """
    everything = F.concat_ws("", *names)
    marked = F.contains(everything, F.lit(_NO_TEXT)) | F.contains(everything, F.lit(_NEXT_TEXT))
    one = F.concat_ws(_NEXT_TEXT, *[F.coalesce(F.col(n), F.lit(_NO_TEXT)) for n in names])
    return df.withColumns({"_texts": F.when(~marked, one), "_marked": F.when(marked, F.array(*names))}).drop(*names)


def _unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    """The text columns that :func:`_packed` was given."""
    cut = computed_once(df, _cut=F.split("_texts", _NEXT_TEXT, -1))
    text = lambda i: F.coalesce(F.get("_marked", F.lit(i)), F.nullif(F.get("_cut", F.lit(i)), F.lit(_NO_TEXT)))
    return cut.withColumns({n: text(i) for i, n in enumerate(names)}).drop("_texts", "_marked", "_cut")


def statement_fact(statements: DataFrame) -> DataFrame:
    """Newest version of each statement as a flat row, marked ``LATEST``.

    Amounts stay text; all are in the result, NULL where the input has no such
    column.  ``statements`` has ``id`` (statement id), ``version``,
    ``sequence`` and the nested document columns.  Amounts travel as one text.
    """
    texts = [c for c in STATEMENT_AMOUNTS if dict(statements.dtypes).get(c) == "string"]
    newest = latest_version_per_id(_packed(statements, texts) if texts else statements, ["id"], ["version", "sequence"])
    newest = _unpacked(newest, texts) if texts else newest
    held = set(newest.columns)
    amounts = [(F.col(c) if c in held else F.lit(None).cast("string")).alias(c.lower()) for c in STATEMENT_AMOUNTS]
    period = F.col("assessmentPeriod")
    day = lambda name: dates.int_to_date(period[name])
    return newest.select(
        F.col("id").alias("statement_id"),
        period["contractId"].alias("contract_id"),
        period["assessmentPeriodId"].alias("assessment_period_id"),
        *amounts,
        day("startDate").alias("period_start"),
        day("endDate").alias("period_end"),
        F.col("version").alias("version"),
        F.timestamp_millis(F.col("version")).alias("last_modified_ts"),
        F.timestamp_millis(F.col("version")).cast("date").alias("last_modified_date"),
        F.lit("LATEST").alias("latest_marker"),
    )


def message_version_filter(statements: DataFrame, raw: Column, id_col: Column) -> DataFrame:
    """Statements of the reconsideration type with a fixed reason and their raw JSON."""
    return statements.where(F.col("type") == RECONSIDERATION_TYPE).select(
        id_col.alias("statement_id"), F.lit(RECONSIDERATION_REASON).alias("reason"), raw.alias("raw_json")
    )


def _json_pieces(text: Column) -> Column:
    """JSON text cut into keys (with their colon), strings and everything between.

    Strings are matched whole, so a colon, quote or word inside a value is never
    taken for structure.  The pattern is unrolled and possessive: the matcher
    keeps no state per character, however long the string.
    """
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    return F.regexp_extract_all(text, F.lit(rf"(?s){string}\s*+:|{string}|[^\"]++"), F.lit(0))


_IS_KEY = r'(?s)^".*"\s*:$'


def _lower_key(piece: Column) -> Column:
    return F.when(piece.rlike(_IS_KEY), F.lower(piece)).otherwise(piece)


def _fill_null(piece: Column) -> Column:
    return F.when(piece.startswith('"'), piece).otherwise(F.regexp_replace(piece, r"\bnull\b", '"null"'))


def lower_case_keys(text: Column) -> Column:
    """JSON text with every object key in lower case; values are untouched."""
    return F.concat_ws("", F.transform(_json_pieces(text), _lower_key))


def nulls_as_text(text: Column) -> Column:
    """JSON text with each null literal replaced by the text ``"null"``."""
    return F.concat_ws("", F.transform(_json_pieces(text), _fill_null))


def lower_keys_and_fill_nulls(text: Column) -> Column:
    """Both of the above with the text cut only once."""
    return F.concat_ws("", F.transform(_json_pieces(text), lambda p: _fill_null(_lower_key(p))))


def product_contract(contracts: DataFrame, people_json: Column) -> DataFrame:
    """Contract view: one row per person, as JSON with lower-case keys and null texts.

    ``people_json`` is a JSON array of objects; a contract without people gives one
    row with NULL.
    """
    day = lambda c: dates.int_to_date(F.col(c)).cast("timestamp")
    persons = F.explode_outer(F.from_json(people_json, "array<string>"))
    flat = contracts.select("*", persons.alias("_person"))
    return flat.select(
        F.col("_id.contractId").alias("contract_id"),
        day("declaredDate").alias("declared_date"),
        day("startDate").alias("start_date"),
        day("closedDate").alias("closed_date"),
        F.when(F.col("_person").isNotNull(), lower_keys_and_fill_nulls(F.col("_person"))).alias("person"),
    )


def raw_json_dated(lines: DataFrame, export_date: Column, value: str = "value") -> DataFrame:
    """Raw JSON lines with their export date, ready to be partitioned by it."""
    return lines.select(F.col(value).alias("val"), export_date.alias("export_date"))


def analytical_dataset(records: DataFrame, classification: DataFrame, snapshot_type: str) -> DataFrame:
    """Records of each collection with their object tags.

    ``records``: ``database, collection, value``; ``classification``:
    ``database, collection, pii`` (one row per collection), written once so that
    records are not shuffled on their few collections when it is small.
    """
    classification = materialise(classification, "classification")
    tags = F.create_map(
        F.lit("pii"), F.coalesce("pii", F.lit("")),
        F.lit("db"), F.col("database"),
        F.lit("table"), F.col("collection"),
        F.lit("snapshot_type"), F.lit(snapshot_type),
    )
    return records.join(classification, ["database", "collection"], "left").select(
        "database", "collection", "value", tags.alias("tags")
    )
