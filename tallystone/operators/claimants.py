"""Queries over claimant, contract and statement documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.session import materialise


def contract_people(contracts: DataFrame) -> DataFrame:
    """One row per contract and person on it, with the contract's dates and periods."""
    return contracts.select(
        F.col("_id.contractId").alias("contractId"),
        F.explode("people").alias("citizenId"),
        "closedDate",
        F.col("claimSuspension.suspensionDate").alias("suspendedDate"),
        "assessmentPeriods",
    )


def _is_open(today: Column) -> Column:
    return F.col("closedDate").isNull() | (F.col("closedDate") >= today)


def claimant_status(claimants: DataFrame, contracts: DataFrame, today: Column) -> DataFrame:
    """Per claimant: found (has an open contract) and suspended.

    A contract closed before ``today`` (yyyymmdd) does not count.  The contract
    side is reduced to one row per citizen before the join.
    """
    open_now = _is_open(today)
    per_citizen = contract_people(contracts).groupBy("citizenId").agg(
        F.count_if(open_now).alias("open_contracts"),
        F.count_if(open_now & F.col("suspendedDate").isNotNull()).alias("suspended_contracts"),
    )
    return (
        claimants.select(F.col("_id.citizenId").alias("citizenId"), "nino")
        .join(per_citizen, "citizenId", "left")
        .select(
            "citizenId",
            "nino",
            (F.coalesce("open_contracts", F.lit(0)) > 0).alias("found"),
            (F.coalesce("suspended_contracts", F.lit(0)) > 0).alias("suspended"),
        )
    )


AWARD_COLUMNS = (
    "citizenId", "nino", "found", "contractId", "suspendedDate",
    "assessmentPeriodId", "startDate", "endDate", "takeHomePay",
)


def _pay(statements: DataFrame) -> DataFrame:
    return statements.select(
        F.col("assessmentPeriod.contractId").alias("contractId"),
        F.col("assessmentPeriod.assessmentPeriodId").alias("assessmentPeriodId"),
        "takeHomePay",
    )


def _awarded(held: DataFrame, pay: DataFrame) -> DataFrame:
    period = F.get(
        F.filter("assessmentPeriods", lambda p: p["assessmentPeriodId"] == F.col("assessmentPeriodId")), F.lit(0)
    )
    return (
        held.join(pay, "contractId")
        .withColumn("period", period)
        .select("*", "period.startDate", "period.endDate", F.lit(True).alias("found"))
        .select(*AWARD_COLUMNS)
    )


def claimant_award_join(claimants: DataFrame, contracts: DataFrame, statements: DataFrame, today: Column) -> DataFrame:
    """Awards of every claimant: open contracts, their periods and take-home pay.

    Built from three disjoint parts so that every large join is an inner join,
    which the adaptive plan can split on either side: one contract may own a
    third of all statements, one citizen a third of all contracts.

    1. contracts with statements: the period is looked up in the contract's own
       array (a bounded list inside one document), so periods are never joined;
    2. open contracts without a statement;
    3. claimants without an open contract (``found`` is false).
    """
    who = claimants.select(F.col("_id.citizenId").alias("citizenId"), "nino")
    people = contract_people(contracts).where(_is_open(today))
    held = materialise(who.join(people, "citizenId"), "holders")
    pay = _pay(statements)
    awarded = _awarded(held, pay)
    blank = lambda name, kind: F.lit(None).cast(kind).alias(name)
    no_award = [
        blank("assessmentPeriodId", "string"), blank("startDate", "int"),
        blank("endDate", "int"), blank("takeHomePay", "string"),
    ]
    unpaid = (
        held.drop("assessmentPeriods")
        .join(pay.select("contractId").distinct(), "contractId", "left_anti")
        .select("citizenId", "nino", F.lit(True).alias("found"), "contractId", "suspendedDate", *no_award)
    )
    absent = (
        who.join(held.select("citizenId").distinct(), "citizenId", "left_anti")
        .select(
            "citizenId", "nino", F.lit(False).alias("found"),
            blank("contractId", "string"), blank("suspendedDate", "int"), *no_award,
        )
    )
    return awarded.unionByName(unpaid).unionByName(absent)


def claimant_date_query(awards: DataFrame, from_date: Column, to_date: Column) -> DataFrame:
    """Periods contained in [from, to]; a period that only overlaps is left out."""
    return awards.where((F.col("startDate") >= from_date) & (F.col("endDate") <= to_date))


def claimant_awards_between(
    claimants: DataFrame, contracts: DataFrame, statements: DataFrame, today: Column, from_date: Column, to_date: Column
) -> DataFrame:
    """:func:`claimant_date_query` of all awards, with the range applied before any join.

    Each contract keeps the periods of its own array that lie in the range, and a
    contract without one is dropped where it is scanned.
    """
    inside = F.filter("assessmentPeriods", lambda p: (p["startDate"] >= from_date) & (p["endDate"] <= to_date))
    few = contracts.withColumn("assessmentPeriods", inside).where(F.size("assessmentPeriods") > 0)
    who = claimants.select(F.col("_id.citizenId").alias("citizenId"), "nino")
    held = contract_people(few).where(_is_open(today)).join(who, "citizenId")
    return _awarded(held, _pay(statements)).where("startDate is not null")
