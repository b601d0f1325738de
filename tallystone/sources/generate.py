"""Synthetic records, built row by row on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import dates
from tallystone.functions.secrets import national_id

# How record ids are shared.
KEY_METHODS = ("single", "different", "file", "record", "static", "topic", "message")


# Records expanded per row of work.
BLOCK = 10_000


def stable_uuid(*seed: Column) -> Column:
    """Text in UUID form that only depends on its seed."""
    h = F.md5(F.concat_ws("/", *[s.cast("string") for s in seed]))
    cut = lambda start, n: F.substring(h, start, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def record_key(method: str, topic: Column, file_no: Column, record_no: Column) -> Column:
    """Id of a generated record under one of the key methods.

    ``single``/``static``: one id for all; ``topic``: one per topic; ``file``:
    one per file of a topic; ``record``: one per record position, equal across
    files; ``different``/``message``: one per record.
    """
    if method not in KEY_METHODS:
        raise ValueError(f"unknown key method {method}")
    seeds = {
        "single": [F.lit("all")],
        "static": [F.lit("all")],
        "topic": [topic],
        "file": [topic, file_no],
        "record": [topic, record_no],
        "different": [topic, file_no, record_no],
        "message": [topic, file_no, record_no],
    }
    return stable_uuid(*seeds[method])


def generate_records(
    requests: DataFrame, template: str, method: str, base_ts: Column
) -> DataFrame:
    """Render a message template for every file and record of each request.

    ``requests``: ``topic, files, records``.  ``||newid||`` and
    ``||timestamp||`` are replaced; record n is n milliseconds after the base,
    file numbers shift the base by one millisecond each.
    """
    first = F.explode(F.sequence(F.lit(0), F.ceil(F.col("records") / BLOCK).cast("int") - 1)).alias("block")
    blocks = (
        requests.where("files > 0 and records > 0")
        .select("topic", "records", F.explode(F.sequence(F.lit(1), F.col("files"))).alias("file_no"))
        .select("*", first)
        # a few request rows may stand for billions of records: spread the blocks
        .repartition("topic", "file_no", "block")
    )
    start = F.col("block") * BLOCK + 1
    stop = F.least(F.col("records"), (F.col("block") + 1) * BLOCK)
    numbered = blocks.select("topic", "file_no", F.explode(F.sequence(start, stop)).alias("record_no"))
    key = record_key(method, F.col("topic"), F.col("file_no"), F.col("record_no"))
    stamp = dates.add_millis(base_ts, F.col("record_no") + F.col("file_no") - 1)
    value = F.replace(F.lit(template), F.lit("||newid||"), key)
    return numbered.select(
        "topic",
        "file_no",
        "record_no",
        key.alias("key"),
        stamp.alias("timestamp"),
        F.replace(value, F.lit("||timestamp||"), stamp).alias("value"),
    )


def generate_table(rows: DataFrame, columns: dict[str, str], seed: int) -> DataFrame:
    """Random values for the declared columns, one output row per input row.

    Text is eight letters or NULL with equal odds, anything else 0..100.  Values
    depend on the seed and the row number only, so a rerun of a lost task
    produces the same rows.
    """
    out = []
    for i, (name, kind) in enumerate(columns.items()):
        draw = lambda n, j, i=i: F.pmod(F.xxhash64("row_no", F.lit(seed), F.lit(i), F.lit(j)), F.lit(n)).cast("int")
        if kind == "string":
            letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
            text = F.concat(*[F.substring(letters, draw(52, j) + 1, F.lit(1)) for j in range(8)])
            out.append(F.when(draw(2, 99) == 0, text).alias(name))
        else:
            out.append(draw(101, 0).alias(name))
    return rows.select("row_no", *out)


def generate_claimants(scenarios: DataFrame, today: Column) -> dict[str, DataFrame]:
    """Claimant, contract and statement documents of a table of scenarios.

    ``scenarios``: ``scenario_id, count int, partner boolean, closed_days int,
    suspended_days int, assessment_periods array<struct<start_days, start_months,
    end_days, end_months, amount>>``.  ``count`` repeats a scenario and
    ``partner`` adds a second person to its contract.
    """
    each = scenarios.withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest("count", F.lit(1)))))
    seed = lambda word: stable_uuid(F.col("scenario_id"), F.col("n"), F.lit(word))
    people = F.when(F.col("partner"), F.array(seed("citizen"), seed("partner"))).otherwise(F.array(seed("citizen")))
    or_zero = lambda c: F.coalesce(c, F.lit(0))
    at = lambda days, months: dates.date_to_int(dates.offset_date(today, or_zero(days), or_zero(months)))
    based = each.select("*", people.alias("people"), seed("contract").alias("contract"))
    claimants = based.select(F.explode("people").alias("citizenId")).select(
        F.struct("citizenId").alias("_id"), national_id(F.col("citizenId")).alias("nino")
    )
    periods = F.transform(
        "assessment_periods",
        lambda p, i: F.struct(
            F.concat_ws("-", F.col("contract"), i.cast("string")).alias("assessmentPeriodId"),
            F.col("contract").alias("contractId"),
            at(p["start_days"], p["start_months"]).alias("startDate"),
            at(p["end_days"], p["end_months"]).alias("endDate"),
        ),
    )
    offset_or_null = lambda c: F.when(F.col(c).isNotNull(), at(F.col(c), F.lit(0)))
    contracts = based.select(
        F.struct(F.col("contract").alias("contractId")).alias("_id"),
        "people",
        offset_or_null("closed_days").alias("closedDate"),
        F.struct(offset_or_null("suspended_days").alias("suspensionDate")).alias("claimSuspension"),
        periods.alias("assessmentPeriods"),
    )
    statements = based.select(
        F.explode(F.arrays_zip(periods.alias("p"), F.transform("assessment_periods", lambda p: p["amount"]).alias("amount"))).alias("s")
    ).select(
        F.struct(F.concat(F.lit("s-"), F.col("s.p.assessmentPeriodId")).alias("statementId")).alias("_id"),
        F.col("s.p").alias("assessmentPeriod"),
        F.col("s.amount").alias("takeHomePay"),
        F.lit("CALCULATED").alias("type"),
    )
    return {"claimants": claimants, "contracts": contracts, "statements": statements}
