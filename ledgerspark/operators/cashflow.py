"""Cash flow: daily balances, collisions with a floor, and remedies that are known to work.

Moving an amount from its due day to a later one raises the intraday low by that amount on the
days in between and changes no other day; paying the minimum raises it by the rest from the due
day on. So remedies need no simulation: one join of collisions with obligations per account.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.calendar import expand_occurrences
from ledgerspark.functions.money import confidence_rank, weakest_confidence

MOST_DAYS = 1095


class CashFlow(NamedTuple):
    days: DataFrame
    collisions: DataFrame
    remedies: DataFrame
    summary: DataFrame
    flagged: DataFrame
    out_of_horizon: DataFrame
    rejects: DataFrame
    collision_events: DataFrame


def obligations_from_statements(view: DataFrame) -> DataFrame:
    """Minimum dues where stated, else whole balances, of statements with a due date; per owner and currency."""
    due = view.where("due_date IS NOT NULL AND statement_minor > 0")
    base = lambda rule, amount: due.where(rule).select("owner_id", "currency", F.concat(F.col("account_id"), F.lit(":due")).alias("id"), F.col("due_date").alias("due_on"), F.col(amount).alias("amount_minor"))
    return base("minimum_due_minor > 0", "minimum_due_minor").unionByName(base("coalesce(minimum_due_minor, 0) = 0", "statement_minor"))


def _judged(rows: DataFrame, requests: DataFrame, kind: str, dup: bool) -> DataFrame:
    """The rows with their request and a reason where they are refused."""
    req = requests.select("account_id", F.col("currency").alias("__currency"), "today", "last")
    both = rows.join(req, "account_id", "left")
    reason = F.when(F.col("__currency").isNull(), "unknown_account").when(F.col("currency") != F.col("__currency"), "currency").when(F.col("amount_minor") < 0, "negative")
    if dup:
        n = rows.groupBy("account_id", "id").agg(F.count(F.lit(1)).alias("__n"))
        both = both.join(n, ["account_id", "id"])
        reason = reason.when(F.col("__n") > 1, "duplicate_id").when(F.col("minimum_due_minor") > F.col("amount_minor"), "minimum_above_amount")
        both = both.withColumn("reason", reason).drop("__n")
    else:
        both = both.withColumn("reason", reason)
    return both.withColumn("what", F.lit(kind)).drop("__currency")


def project_cash_flow(requests: DataFrame, obligations: DataFrame, inflows: DataFrame | None = None, recurring: DataFrame | None = None) -> CashFlow:
    """Projects every account of ``requests`` day by day.

    requests: account_id, today, horizon_days (1..1095), opening_minor, floor_minor, currency, max_deferral_days;
    obligations: account_id, id, due_on, amount_minor, currency, movable, latest_move_to, minimum_due_minor, confidence;
    inflows: account_id, id, expected_on, amount_minor, currency, confidence; recurring: account_id, id, kind, interval,
    second_day, anchor, amount_minor, currency, confidence, ends_on. Refused rows are in ``rejects`` with a reason, dated
    rows outside the horizon in ``out_of_horizon``. The outflows of a collision's days are rows of ``collision_events``
    (obligations among them are marked), in the order in which they fall.
    """
    asked = requests.withColumn("last", F.date_add("today", F.col("horizon_days")))
    fine = F.col("horizon_days").between(1, MOST_DAYS)
    refused = asked.where(~fine).select("account_id", F.lit("request").alias("what"), F.col("account_id").alias("id"), F.lit("horizon").alias("reason"))
    asked = asked.where(fine)
    owed = _judged(obligations, asked, "obligation", True)
    events = [owed.select("account_id", "id", "what", F.col("due_on").alias("day"), (-F.col("amount_minor")).alias("amount_minor"), F.coalesce("confidence", F.lit("high")).alias("confidence"), "reason", "today", "last")]
    if inflows is not None:
        rows = _judged(inflows, asked, "inflow", False)
        events.append(rows.select("account_id", "id", "what", F.col("expected_on").alias("day"), "amount_minor", F.coalesce("confidence", F.lit("high")).alias("confidence"), "reason", "today", "last"))
    if recurring is not None:
        rows = _judged(recurring, asked, "recurring", False)
        bad = rows.where("reason IS NOT NULL").withColumn("occurs_on", F.col("today"))
        slots = expand_occurrences(rows.where("reason IS NULL"), F.col("today"), F.least("last", F.coalesce("ends_on", "last")))
        rows = slots.unionByName(bad, allowMissingColumns=True)
        events.append(rows.select("account_id", "id", "what", F.col("occurs_on").alias("day"), "amount_minor", F.coalesce("confidence", F.lit("medium")).alias("confidence"), "reason", "today", "last"))
    flow = events[0]
    for more in events[1:]:
        flow = flow.unionByName(more)
    rejects = refused.unionByName(flow.where("reason IS NOT NULL").select("account_id", "what", "id", "reason"))
    flow = flow.where("reason IS NULL")
    inside = flow.where(F.col("day").between(F.col("today"), F.col("last")))
    outside = flow.where(~F.col("day").between(F.col("today"), F.col("last"))).select("account_id", "what", "id", "day")
    flagged = inside.where("confidence <> 'high'").select("account_id", "what", "id", "day", "confidence")

    net = inside.groupBy("account_id", "day").agg(F.sum(F.when(F.col("amount_minor") < 0, -F.col("amount_minor")).otherwise(0)).alias("outflow_minor"), F.sum(F.greatest("amount_minor", F.lit(0))).alias("inflow_minor"))
    spine = asked.select("account_id", "opening_minor", "floor_minor", "currency", F.explode(F.sequence("today", "last")).alias("day"))
    rows = spine.join(net, ["account_id", "day"], "left").na.fill(0, ["outflow_minor", "inflow_minor"])
    change = F.col("inflow_minor") - F.col("outflow_minor")
    closing = F.col("opening_minor") + F.sum(change).over(Window.partitionBy("account_id").orderBy("day"))
    days = rows.withColumn("closing_minor", closing).withColumn("opening_day_minor", F.col("closing_minor") - change)
    days = days.withColumn("low_minor", F.col("opening_day_minor") - F.col("outflow_minor")).withColumn("below", F.col("low_minor") < F.col("floor_minor"))
    days = days.withColumn("shortfall_minor", F.when(F.col("below"), F.col("floor_minor") - F.col("low_minor")).otherwise(0))

    island = F.date_sub("day", F.row_number().over(Window.partitionBy("account_id").orderBy("day")))
    breached = days.where("below").withColumn("island", island)
    collisions = breached.groupBy("account_id", "island").agg(
        F.min("day").alias("from_day"), F.max("day").alias("to_day"), F.min(F.struct("low_minor", "day")).alias("worst"), F.max("shortfall_minor").alias("shortfall_minor"),
    ).select("account_id", "from_day", "to_day", F.col("worst.day").alias("worst_day"), F.col("worst.low_minor").alias("worst_minor"), "shortfall_minor")
    starts = breached.withColumn("from_day", F.min("day").over(Window.partitionBy("account_id", "island"))).select("account_id", "day", "from_day")
    order = Window.partitionBy("account_id", "from_day").orderBy("day", "id", "what")
    collision_events = inside.where("amount_minor < 0").join(starts, ["account_id", "day"]).select(
        "account_id", "from_day", "day", "id", (F.col("what") == "obligation").alias("obligation"), (-F.col("amount_minor")).alias("outflow_minor"), F.row_number().over(order).alias("ordinal"),
    )
    remedies = _remedies(days, collisions, owed.where("reason IS NULL"), asked)
    lows = days.groupBy("account_id", "currency").agg(
        F.min(F.struct("low_minor", "day")).alias("low"), F.min(F.struct("closing_minor", "day")).alias("trough"), F.max_by("closing_minor", "day").alias("closing_minor"),
        F.sum("inflow_minor").alias("inflow_minor"), F.sum("outflow_minor").alias("outflow_minor"), F.count_if("below").alias("days_below"), F.first("opening_minor").alias("opening_minor"), F.min("day").alias("first_day"),
    )
    sure = inside.groupBy("account_id").agg(F.min(confidence_rank(F.col("confidence"))).alias("rank"), F.count_if(F.col("amount_minor") > 0).alias("n_in"))
    lower = F.col("low.low_minor") < F.col("opening_minor")
    summary = lows.join(sure, "account_id", "left").select(
        "account_id", "currency", "opening_minor", "closing_minor", "inflow_minor", "outflow_minor", "days_below",
        F.least("opening_minor", "low.low_minor").alias("lowest_minor"), F.when(lower, F.col("low.day")).otherwise(F.col("first_day")).alias("lowest_on"), F.col("trough.day").alias("trough_on"),
        F.when(F.col("rank").isNull(), "high").when((F.col("n_in") == 0) | (F.col("rank") == 0), "low").when(F.col("rank") == 1, "medium").otherwise("high").alias("confidence"),
    )
    return CashFlow(days, collisions, remedies, summary, flagged, outside, rejects, collision_events)


def _remedies(days: DataFrame, collisions: DataFrame, owed: DataFrame, asked: DataFrame) -> DataFrame:
    """Ranked remedies of each collision: rank 1 is the best."""
    limits = asked.select("account_id", F.coalesce("max_deferral_days", F.lit(90)).alias("deferral"), "opening_minor", "floor_minor")
    pair = collisions.join(owed.where(F.col("due_on").between(F.col("today"), F.col("last"))), "account_id").where("due_on <= from_day").join(limits, "account_id")
    target = F.least(F.date_add("due_on", F.col("deferral")), F.coalesce("latest_move_to", "last"), "last")
    key = ["account_id", "from_day", "to_day", "id"]
    base = [*key, "due_on", "opening_minor", "floor_minor"]
    move = pair.where(F.col("movable") & (F.col("amount_minor") >= F.col("shortfall_minor")) & (F.date_add("to_day", 1) <= target))
    move = move.select(*base, F.lit("move_payment").alias("remedy"), F.date_add("to_day", 1).alias("to_date"), F.col("amount_minor").alias("lift_minor"), F.datediff(F.date_add("to_day", 1), "due_on").alias("displacement"))
    part = F.col("amount_minor") - F.col("minimum_due_minor")
    least = pair.where((F.col("minimum_due_minor") < F.col("amount_minor")) & (part >= F.col("shortfall_minor")))
    least = least.select(*base, F.lit("pay_minimum").alias("remedy"), F.lit(None).cast("date").alias("to_date"), part.alias("lift_minor"), F.lit(0).alias("displacement"))
    found = move.unionByName(least)
    each = found.join(days.select("account_id", "day", "low_minor"), "account_id")
    lifted = F.col("low_minor") + F.when((F.col("day") >= F.col("due_on")) & (F.col("to_date").isNull() | (F.col("day") < F.col("to_date"))), F.col("lift_minor")).otherwise(0)
    worst = each.groupBy(*found.columns).agg(F.min(lifted).alias("low"))
    done = worst.withColumns({"resulting_worst_minor": F.least("opening_minor", "low"), "clears_all": F.col("low") >= F.col("floor_minor")})
    order = [F.desc("clears_all"), F.when(F.col("remedy") == "move_payment", 0).otherwise(1), "displacement", "id", "to_date"]
    rank = F.row_number().over(Window.partitionBy("account_id", "from_day").orderBy(*order))
    return done.withColumn("rank", rank).select(*key, "remedy", "to_date", "displacement", F.col("lift_minor").alias("deferred_minor"), "resulting_worst_minor", "clears_all", "rank")


def balance_on(days: DataFrame, day: Column) -> DataFrame:
    return days.where(F.col("day") == day).select("account_id", "closing_minor")


def what_if(days: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenario, account_id, trough: the least closing after adding each scenario's delta_minor (per account)."""
    rows = days.join(scenarios, "account_id").withColumn("closing", F.col("closing_minor") + F.col("delta_minor"))
    return rows.groupBy("scenario", "account_id").agg(F.min(F.struct("closing", "day")).alias("t")).select("scenario", "account_id", F.col("t.closing").alias("trough_minor"), F.col("t.day").alias("trough_on"))


__all__ = ["CashFlow", "balance_on", "obligations_from_statements", "project_cash_flow", "weakest_confidence", "what_if"]


def day_events(events: DataFrame) -> DataFrame:
    """account_id, day, events: the ids of a day (id, direction), outflows first, then by id."""
    rank = F.when(F.col("direction") == "outflow", 0).otherwise(1)
    listed = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "id")))
    return events.groupBy("account_id", "day").agg(F.transform(listed, lambda e: e["id"]).alias("events"))


def all_assumptions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with every assumption (array of texts) of their rows, once and in order."""
    return rows.select(*keys, F.explode("assumptions").alias("one")).groupBy(*keys).agg(F.sort_array(F.collect_set("one")).alias("assumptions"))
