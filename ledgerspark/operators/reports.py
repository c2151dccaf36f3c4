"""Reports over months: totals, fees, attribution of change, budgets, commitments, statement gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_totals(ledger: DataFrame) -> DataFrame:
    """Money in and out per owner, currency and month."""
    return ledger.groupBy("owner_id", "currency", F.date_format("posted_at", "yyyy-MM").alias("month")).agg(
        F.sum(F.greatest("amount_minor", F.lit(0))).alias("inflow_minor"), F.sum(F.when(F.col("amount_minor") < 0, -F.col("amount_minor")).otherwise(0)).alias("outflow_minor"), F.count(F.lit(1)).alias("n"),
    )


def fee_evidence(ledger: DataFrame, as_of) -> DataFrame:
    """The transactions of each fee total (owner_id, currency, fee_type): fees of the twelve months up to a date."""
    day = F.lit(as_of).cast("date")
    rows = ledger.where(F.col("fee_type").isNotNull() & (F.col("posted_at") > F.add_months(day, -12)) & (F.col("posted_at") <= day))
    return rows.select("owner_id", "currency", "fee_type", "txn_id", "posted_at", F.abs("amount_minor").alias("fee_minor"))


def fee_ledger(ledger: DataFrame, as_of) -> DataFrame:
    """Fees of the twelve months up to a date per owner, currency and type (column fee_type), with the evidence's count and span; ``fee_evidence`` has its rows."""
    return fee_evidence(ledger, as_of).groupBy("owner_id", "currency", "fee_type").agg(F.sum("fee_minor").alias("fee_minor"), F.count(F.lit(1)).alias("n"), F.min("txn_id").alias("first_txn"), F.max("txn_id").alias("last_txn"))


def attribution(ledger: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """Change of each key from the month before, as volume, price, new and lapsed effects that add up exactly.

    volume = (n - n before) * the average before, half away from zero; price is the rest of the change.
    """
    sums = ledger.groupBy(*keys, "currency", month).agg(F.sum("amount_minor").alias("total"), F.count(F.lit(1)).alias("n"))
    prior = sums.withColumn(month, F.date_format(F.add_months(F.to_date(F.concat(F.col(month), F.lit("-01"))), 1), "yyyy-MM")).withColumnRenamed("total", "was").withColumnRenamed("n", "n_was")
    both = sums.join(prior, [*keys, "currency", month], "full_outer")
    delta = F.coalesce("total", F.lit(0)) - F.coalesce("was", F.lit(0))
    volume = F.round((F.col("n") - F.col("n_was")) * F.col("was") / F.col("n_was")).cast("bigint")
    old = F.col("was").isNotNull() & F.col("total").isNotNull()
    return both.select(
        *keys, "currency", month, delta.alias("delta_minor"), F.when(old, volume).otherwise(0).alias("volume_minor"), F.when(old, delta - volume).otherwise(0).alias("price_minor"),
        F.when(F.col("was").isNull(), F.col("total")).otherwise(0).alias("new_minor"), F.when(F.col("total").isNull(), -F.col("was")).otherwise(0).alias("lapsed_minor"),
    )


def budget_status(budgets: DataFrame, ledger: DataFrame, recurring: DataFrame, as_of) -> DataFrame:
    """Spent, left with rollover, and the month's projection: spent, run rate on the days left, and bills still to come.

    budgets: owner_id, category, currency, month, limit_minor, rollover_minor; ledger has category; recurring: owner_id, category, currency, due_on, amount_minor.
    """
    day = F.lit(as_of).cast("date")
    here = F.date_format(day, "yyyy-MM")
    key = ["owner_id", "category", "currency"]
    spent = ledger.where((F.date_format("posted_at", "yyyy-MM") == here) & (F.col("posted_at") <= day) & (F.col("amount_minor") < 0)).groupBy(*key).agg(F.sum(-F.col("amount_minor")).alias("spent_minor"))
    bills = recurring.where((F.date_format("due_on", "yyyy-MM") == here) & (F.col("due_on") > day)).groupBy(*key).agg(F.sum("amount_minor").alias("due_minor"))
    rows = budgets.where(F.col("month") == here).join(spent, key, "left").join(bills, key, "left").na.fill(0, ["spent_minor", "due_minor"])
    rate = F.round(F.col("spent_minor") * (F.dayofmonth(F.last_day(day)) - F.dayofmonth(day)) / F.dayofmonth(day)).cast("bigint")
    allowed = F.col("limit_minor") + F.coalesce("rollover_minor", F.lit(0))
    return rows.select(*key, "month", "spent_minor", (allowed - F.col("spent_minor")).alias("left_minor"), (F.col("spent_minor") + rate + F.col("due_minor")).alias("projected_minor"))


def verify_commitments(commitments: DataFrame, monthly: DataFrame) -> DataFrame:
    """Realised saving of each commitment (commitment_id, owner_id, currency, merchant_key, month, saving_type): what the month before cost more.

    Hard and soft savings stay apart: sum them under saving_type only.
    """
    cost = monthly.select("owner_id", "currency", "merchant_key", "month", "cost_minor")
    before = cost.withColumn("month", F.date_format(F.add_months(F.to_date(F.concat(F.col("month"), F.lit("-01"))), 1), "yyyy-MM")).withColumnRenamed("cost_minor", "was_minor")
    key = ["owner_id", "currency", "merchant_key", "month"]
    both = commitments.join(before, key, "left").join(cost, key, "left")
    saved = F.coalesce("was_minor", F.lit(0)) - F.coalesce("cost_minor", F.lit(0))
    return both.select("commitment_id", "owner_id", "currency", "saving_type", saved.alias("saved_minor"), F.when(F.col("was_minor").isNull(), "unverifiable").when(saved > 0, "realised").otherwise("not_realised").alias("outcome"))


def statement_gate(statements: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements whose lines add up to the stated total, and those that fail with the difference."""
    sums = lines.groupBy("statement_id").agg(F.sum("amount_minor").alias("lines_minor"))
    both = statements.join(sums, "statement_id", "left").withColumn("difference_minor", F.coalesce("lines_minor", F.lit(0)) - F.col("balance_minor"))
    return both.where("difference_minor = 0"), both.where("difference_minor <> 0").withColumn("reason", F.lit("total_mismatch"))
