"""Debt: positions, totals per currency, due dates, bands."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.money import confidence_rank, weakest_confidence


class DebtMap(NamedTuple):
    positions: DataFrame
    totals: DataFrame
    rejects: DataFrame


class DueCalendar(NamedTuple):
    entries: DataFrame
    day_totals: DataFrame
    overdue: DataFrame
    undated: DataFrame


def debt_map(accounts: DataFrame, today, staleness_days: int = 35) -> DebtMap:
    """Per account: age of the balance, days until due, overdue, stale, confidence; per owner and currency: totals and coverage.

    ``accounts``: account_id, owner_id, currency, owed_minor, minimum_due_minor, due_on, observed_on, apr_bp, confidence.
    Negative amounts, a minimum above the balance, rates outside 0..10000 and repeated ids are rejected.
    """
    day = F.lit(today).cast("date")
    n = accounts.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    reason = (
        F.when(F.col("n") > 1, "duplicate_account")
        .when(F.col("owed_minor") < 0, "negative_balance")
        .when(F.col("minimum_due_minor") < 0, "negative_minimum")
        .when(F.col("minimum_due_minor") > F.col("owed_minor"), "minimum_above_balance")
        .when(~F.col("apr_bp").between(0, 10000), "apr_out_of_range")
    )
    judged = accounts.join(n, "account_id").withColumn("reason", reason).drop("n")
    good = judged.where("reason IS NULL").drop("reason")
    stale = F.col("observed_on").isNull() | (F.datediff(day, "observed_on") > staleness_days)
    rank = F.when(F.col("owed_minor").isNull(), 0).when(stale, F.least(F.lit(1), confidence_rank(F.col("confidence")))).otherwise(confidence_rank(F.col("confidence")))
    positions = good.withColumns({
        "age_days": F.datediff(day, "observed_on"),
        "days_until_due": F.datediff("due_on", day),
        "overdue": F.coalesce(F.col("due_on") < day, F.lit(False)),
        "stale": F.coalesce(stale, F.lit(True)),
        "confidence": F.when(rank == 0, "low").when(rank == 1, "medium").otherwise("high"),
    })
    totals = positions.groupBy("owner_id", "currency").agg(
        F.coalesce(F.sum("owed_minor"), F.lit(0)).alias("owed_minor"),
        F.coalesce(F.sum("minimum_due_minor"), F.lit(0)).alias("minimum_due_minor"),
        F.count("owed_minor").alias("observed"),
        F.count(F.lit(1)).alias("total"),
        (F.count("owed_minor") / F.count(F.lit(1))).alias("coverage"),
        F.count_if(F.col("owed_minor").isNull()).alias("missing"),
        F.count_if(F.col("stale") & F.col("owed_minor").isNotNull()).alias("stale"),
        weakest_confidence(F.col("confidence")).alias("confidence"),
    )
    return DebtMap(positions, totals, judged.where("reason IS NOT NULL").select("account_id", "reason"))


def debt_evidence(positions: DataFrame) -> DataFrame:
    """The accounts of each total (owner_id, currency): which of them have no balance, and which an old one."""
    known = F.col("owed_minor").isNotNull()
    return positions.select("owner_id", "currency", "account_id", (~known).alias("missing"), (known & F.col("stale")).alias("stale"))


def due_calendar(accounts: DataFrame, from_, to=None, horizon_days: int | None = None) -> DueCalendar:
    """Entries in from_..to, totals per day and currency (statement balance, else the current one), and what is overdue or undated."""
    start = F.lit(from_).cast("date")
    end = F.lit(to).cast("date") if to is not None else F.date_add(start, horizon_days or 30)
    rows = accounts.withColumn("amount_minor", F.coalesce("statement_minor", "current_minor"))
    entries = rows.where(F.col("due_on").between(start, end))
    totals = entries.groupBy("due_on", "currency").agg(F.sum("amount_minor").alias("amount_minor"), F.coalesce(F.sum("minimum_due_minor"), F.lit(0)).alias("minimum_due_minor"), F.count(F.lit(1)).alias("entries"))
    return DueCalendar(entries, totals, rows.where(F.col("due_on") < start), rows.where("due_on IS NULL"))


def soonest_first() -> list[Column]:
    return [F.asc_nulls_last("due_on"), F.asc("account_id")]


def apr_band(apr_bp: Column, overdue: Column) -> Column:
    return F.when(overdue, "overdue").when(apr_bp.isNull(), "n/a").when(apr_bp > 2000, "high").when(apr_bp > 1500, "elevated").otherwise("normal")


def due_band(days: Column) -> Column:
    return F.when(days.isNull(), "undated").when(days < 0, "overdue").when(days <= 3, "urgent").when(days <= 7, "soon").otherwise("later")
