"""Net worth, exposure, run rates, coverage and runway; always per currency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ASSETS = ("checking", "savings")


def net_worth(accounts: DataFrame) -> DataFrame:
    """Liquid and owed money per owner and currency, and their difference."""
    asset = F.col("kind").isin(*ASSETS)
    sums = accounts.groupBy("owner_id", "currency").agg(
        F.sum(F.when(asset, F.col("balance_minor")).otherwise(0)).alias("assets_minor"),
        F.sum(F.when(~asset, F.abs("balance_minor")).otherwise(0)).alias("debts_minor"),
    )
    return sums.withColumn("net_minor", F.col("assets_minor") - F.col("debts_minor"))


def currency_exposure(worth: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of each currency, percent, by max(net, 0) times the currency's weight; nothing to weigh: 50."""
    held = worth.join(weights, "currency").withColumn("value", F.greatest("net_minor", F.lit(0)) * F.col("weight"))
    total = F.sum("value").over(Window.partitionBy("owner_id"))
    return held.select("owner_id", "currency", F.when(total == 0, 50.0).otherwise(F.col("value") * 100 / total).alias("share"))


def run_rate(bills: DataFrame) -> DataFrame:
    return bills.groupBy("owner_id", "currency").agg(F.sum("monthly_minor").alias("monthly_minor"), (F.sum("monthly_minor") * 12).alias("yearly_minor"), F.count(F.lit(1)).alias("bills"))


def invested(holdings: DataFrame, ytd_rate: float = 0.18) -> DataFrame:
    total = F.sum("value_minor")
    return holdings.groupBy("currency").agg(total.alias("total_minor"), F.round(total * ytd_rate).cast("bigint").alias("ytd_minor"))


def headroom(accounts: DataFrame, today, days: int = 21) -> DataFrame:
    """Money due in the next days per owner and currency, and what the liquid balance leaves."""
    day = F.lit(today).cast("date")
    due = F.when(F.col("due_date").between(day, F.date_add(day, days)), F.col("statement_minor"))
    sums = accounts.groupBy("owner_id", "currency").agg(F.coalesce(F.sum(due), F.lit(0)).alias("due_minor"), F.sum(F.when(F.col("kind").isin(*ASSETS), F.col("balance_minor")).otherwise(0)).alias("liquid_minor"))
    return sums.withColumn("headroom_minor", F.col("liquid_minor") - F.col("due_minor"))


def coverage(accounts: DataFrame, today, declared_missing: DataFrame | None = None, fresh_days: int = 10) -> DataFrame:
    """Accounts seen within the fresh days, of all seen and declared missing, per owner."""
    gap = F.abs(F.datediff(F.lit(today).cast("date"), "observed_on"))
    seen = accounts.groupBy("owner_id").agg(
        F.count_if(gap > fresh_days).alias("stale"), F.count_if(gap <= fresh_days).alias("observed"), F.count(F.lit(1)).alias("known"), F.max("observed_on").alias("latest"),
    )
    if declared_missing is not None:
        seen = seen.join(declared_missing.groupBy("owner_id").agg(F.count(F.lit(1)).alias("missing")), "owner_id", "left")
    else:
        seen = seen.withColumn("missing", F.lit(0))
    total = F.col("known") + F.coalesce("missing", F.lit(0))
    return seen.select("owner_id", "stale", "observed", total.alias("total"), (F.col("observed") / total).alias("ratio"), "latest")


def runway(worth: DataFrame, burn: DataFrame, multiplier: float = 25.0) -> DataFrame:
    """Months that liquid money lasts, the target of ``multiplier`` yearly burns, and progress to it, at most 100 percent."""
    spent = F.greatest(F.abs("burn_minor"), F.lit(100))
    both = worth.join(burn, ["owner_id", "currency"])
    target = F.abs("burn_minor") * 12 * multiplier
    return both.select("owner_id", "currency", (F.col("assets_minor") / spent).alias("months"), target.alias("target_minor"), F.when(target == 0, 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.col("net_minor"), F.lit(0)) * 100 / target)).alias("progress"))


def account_coverage(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("account_id", "source").agg(F.min("posted_at").alias("since"), F.max("posted_at").alias("until"), F.count(F.lit(1)).alias("rows"))


def net_worth_series(observations: DataFrame, from_, to) -> DataFrame:
    """Per day, owner and currency: the sum of each account's last balance by then, and how many accounts count.

    ``observations``: owner_id, account_id, currency, observed_on, balance_minor. Each balance holds until the
    account's next one, so it is turned into changes of the sum and the days are summed up in order.
    """
    start, end = F.lit(from_).cast("date"), F.lit(to).cast("date")
    day = observations.groupBy("owner_id", "account_id", "currency", "observed_on").agg(F.max("balance_minor").alias("balance_minor")).where(F.col("observed_on") <= end)
    before = F.lag("balance_minor").over(Window.partitionBy("account_id", "currency").orderBy("observed_on"))
    change = day.select("owner_id", "currency", F.greatest("observed_on", start).alias("day"), (F.col("balance_minor") - F.coalesce(before, F.lit(0))).alias("change"), F.when(before.isNull(), 1).otherwise(0).alias("new"))
    change = change.groupBy("owner_id", "currency", "day").agg(F.sum("change").alias("change"), F.sum("new").alias("new"))
    spine = change.select("owner_id", "currency").distinct().withColumn("day", F.explode(F.sequence(start, end)))
    running = Window.partitionBy("owner_id", "currency").orderBy("day")
    rows = spine.join(change, ["owner_id", "currency", "day"], "left")
    return rows.select("owner_id", "currency", "day", F.coalesce(F.sum("change").over(running), F.lit(0)).alias("net_minor"), F.coalesce(F.sum("new").over(running), F.lit(0)).alias("accounts"))
