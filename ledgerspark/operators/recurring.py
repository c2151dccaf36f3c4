"""Recurring streams: exclusion, grouping, cadence fitting, and the streams' rows."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.calendar import date_tolerance, describe_cadence, expand_occurrences
from ledgerspark.functions.money import FLOORS, amount_tolerance, as_map, lower_median
from ledgerspark.functions.text import normalize_descriptor
from ledgerspark.operators import _fit
from ledgerspark.operators.ledger import first_of
from ledgerspark.sources.scratch import written

# Phrases of transfers, in the order in which the first one found is reported.
TRANSFERS = ("autopay", "payment thank you", "online payment", "card payment", "credit card payment", "internal transfer", "funds transfer", "transfer to", "transfer from", "ach transfer", "zelle", "neft", "rtgs", "imps")


class RecurringResult(NamedTuple):
    streams: DataFrame
    occurrences: DataFrame
    missed: DataFrame
    excluded: DataFrame
    unassigned: DataFrame
    rejects: DataFrame


def exclusion(amount: Column, kind: Column, normalized: Column, heuristic: bool) -> tuple[Column, Column]:
    """(reason, detail) of a row that no stream may hold; null for others."""
    reason = F.when(amount == 0, "zero_amount").when(kind == "internal_transfer", "internal_transfer").when(kind == "card_payment", "card_payment")
    detail = F.lit(None).cast("string")
    if heuristic:
        for phrase in reversed(TRANSFERS):
            detail = F.when(normalized.rlike(rf"\b{phrase}\b"), phrase).otherwise(detail)
        reason = reason.when(kind.isNull() & detail.isNotNull(), "descriptor_heuristic")
    return reason, F.when(reason == "descriptor_heuristic", detail)


def with_floors(df: DataFrame, account_floors: DataFrame | None = None, currency_floors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """floor_minor from the account, else the currency, else the built-in table; rows without one apart."""
    floor = as_map(FLOORS)[F.col("currency")]
    for floors, key in ((currency_floors, ["currency"]), (account_floors, ["account_id", "currency"])):
        if floors is not None:
            name = f"__{key[0]}"
            df = df.join(floors.select(*key, F.col("floor_minor").alias(name)), key, "left")
            floor = F.coalesce(F.col(name), floor)
    df = df.withColumn("floor_minor", floor.cast("bigint")).drop("__currency", "__account_id")
    return df.where("floor_minor IS NOT NULL"), df.where("floor_minor IS NULL")


_OUT = "account_id string, merchant_key string, direction string, stream int, kind string, interval int, second_day string, anchor date, txn_id string, slot date, posted_at date, amount_minor bigint, breach boolean, reason string, currency string, floor_minor bigint"


_EPOCH = dt.date(1970, 1, 1).toordinal()
_KINDS = {"stream": "Int32", "interval": "Int32", "amount_minor": "Int64", "breach": "boolean", "floor_minor": "Int64"}


def _fitted(cadences, rel: float, coherence: float, tol: int | None):
    def run(key: tuple, g: pd.DataFrame) -> list[tuple]:
        """One group: occurrences, missed slots (no txn_id) and leftovers (no slot); the reason of rows that take no part."""
        date = lambda d: dt.date.fromordinal(int(d) + _EPOCH)
        days = pd.to_datetime(g["posted_at"]).to_numpy().astype("datetime64[D]").astype(np.int64)
        amounts, ids, floor, currencies = g["magnitude"].to_numpy(), g["txn_id"].tolist(), g["floor_minor"].iloc[0], g["currency"]
        told = (currencies.iloc[0], None if pd.isna(floor) else int(floor))
        reason = "mixed_currencies" if currencies.nunique(dropna=True) > 1 else "missing_floor" if pd.isna(floor) else None
        streams, left = ([], np.arange(len(g))) if reason else _fit.peel(days, amounts, ids, int(floor), cadences, rel, coherence, tol)
        out = []
        for n, (cadence, anchor, matches, missed) in enumerate(streams):
            head = (*key, n, *cadence, date(anchor))
            out += [(*head, ids[i], date(s), date(days[i]), int(amounts[i]), bool(b), None, *told) for i, s, b in matches]
            out += [(*head, None, date(s), None, None, None, None, *told) for s in missed]
        return out + [(*key, None, None, None, None, None, ids[i], None, date(days[i]), int(amounts[i]), None, reason, *told) for i in left]

    return run


def detect_recurring(ledger: DataFrame, today, account_floors: DataFrame | None = None, cancellations: DataFrame | None = None, cadences=_fit.CADENCES, date_tolerance_days: int | None = None, default_region: str = "US", min_coherence: float = 0.75, rel: float = 0.02, use_descriptor_heuristic: bool = True) -> RecurringResult:
    """Streams of charges of one account, merchant and direction that keep a calendar rhythm.

    ``ledger``: txn_id, account_id, posted_at, amount_minor, currency, descriptor_raw, region, kind. Repeated ids keep
    their first row by date; groups of several currencies, and currencies without a floor, are rejected. A group is
    the smallest unit of the fit: it is held in one task, others are not.
    """
    region = F.coalesce("region", F.lit(default_region))
    # few files may hold many rows; the ids are what repeated rows are found by, so rows are dealt only once
    # exploding an array of one keeps the optimizer from writing the long expression into each of its uses
    named = ledger.repartition("txn_id").withColumn("normalized", F.explode(F.array(normalize_descriptor(F.col("descriptor_raw"), region))))
    named = named.withColumn("merchant_key", F.when(F.col("normalized") == "", F.concat(F.lit("~raw:"), F.lower(F.trim("descriptor_raw")))).otherwise(F.col("normalized")))
    reason, detail = exclusion(F.col("amount_minor"), F.col("kind"), F.col("normalized"), use_descriptor_heuristic)
    named = named.withColumns({"reason": reason, "detail": detail})
    excluded = named.where("reason IS NOT NULL").select("txn_id", "reason", "detail")
    key = ["account_id", "merchant_key", "direction"]
    rows = named.where("reason IS NULL").select("account_id", "merchant_key", F.when(F.col("amount_minor") < 0, "outflow").otherwise("inflow").alias("direction"), "txn_id", "posted_at", F.abs("amount_minor").alias("magnitude"), "currency")
    first, repeated = first_of(rows, ["txn_id"], ["posted_at", *key, "magnitude", "currency"])
    floored, floorless = with_floors(first, account_floors)
    # the fit is dear and all results come out of it, so it is written once
    fitted = written(_fit.by_group(floored.unionByName(floorless), key, ["posted_at", "txn_id"], _fitted(cadences, rel, min_coherence, date_tolerance_days), _OUT, _KINDS), "recurring")
    rejects = repeated.select("txn_id", F.lit("duplicate_id").alias("reason")).unionByName(fitted.where("reason IS NOT NULL").select("txn_id", "reason"))
    named_rows = fitted.where("stream IS NOT NULL").withColumn("stream_key", F.concat_ws("|", *key, F.col("stream").cast("string"))).drop("reason")
    occurrences, missed = named_rows.where("txn_id IS NOT NULL"), named_rows.where("txn_id IS NULL").select("stream_key", F.col("slot").alias("missed_on"))
    left = fitted.where("stream IS NULL AND reason IS NULL").select("txn_id")
    return RecurringResult(_streams(occurrences, missed, today, cancellations, rel), occurrences.withColumn("deviation", F.datediff("posted_at", "slot")), missed, excluded, left, rejects)


def _streams(occurrences: DataFrame, missed: DataFrame, today, cancellations: DataFrame | None, rel: float) -> DataFrame:
    day = F.lit(today).cast("date")
    head = ["stream_key", "account_id", "merchant_key", "direction", "currency", "floor_minor", "kind", "interval", "second_day", "anchor"]
    rows = occurrences.groupBy(*head).agg(
        lower_median(F.col("amount_minor")).alias("expected_minor"), F.count(F.lit(1)).alias("n"), F.count_if("breach").alias("breaches"), F.min("posted_at").alias("first_seen"),
        F.max("posted_at").alias("last_seen"), (F.max("amount_minor") - F.min("amount_minor")).alias("spread_minor"),
    )
    rows = rows.join(missed.groupBy("stream_key").agg(F.count(F.lit(1)).alias("n_missed")), "stream_key", "left").na.fill(0, ["n_missed"])
    begin = F.date_add("last_seen", 1)
    later = expand_occurrences(rows, begin, F.date_add(day, 400)).select("stream_key", "last_seen", "kind", "interval", "occurs_on")
    tail = later.groupBy("stream_key").agg(
        F.count_if(F.col("occurs_on") <= F.date_sub(day, date_tolerance(F.col("kind"), F.col("interval")))).alias("missed_since"),
        F.min(F.when(F.col("occurs_on") >= day, F.col("occurs_on"))).alias("ahead"), F.max("occurs_on").alias("last_slot"),
    )
    rows = rows.join(tail, "stream_key", "left").na.fill(0, ["missed_since"])
    if cancellations is not None:
        c = cancellations.join(rows.select("stream_key", "account_id", "merchant_key", "first_seen"), ["account_id", "merchant_key"]).where("confirmed_on >= first_seen")
        rows = rows.join(c.groupBy("stream_key").agg(F.min_by("confirmed_on", "seq").alias("cancelled_on")), "stream_key", "left")
    else:
        rows = rows.withColumn("cancelled_on", F.lit(None).cast("date"))
    status = F.when(F.col("cancelled_on").isNotNull(), "cancelled").when(F.col("missed_since") >= 2, "dormant").when(F.col("n") >= 3, "mature").otherwise("candidate")
    rows = rows.withColumn("status", status).withColumns({
        "tolerance_minor": amount_tolerance(F.col("expected_minor"), F.col("floor_minor"), rel),
        "next_expected": F.when(F.col("cancelled_on").isNull(), F.coalesce("ahead", "last_slot")),
        "coherence": 1 - F.col("breaches") / F.col("n"),
        "cadence": describe_cadence(F.col("kind"), F.col("interval"), F.col("second_day")),
        "confidence": F.when(F.col("status") == "candidate", "low").when((F.col("n_missed") == 0) & (F.col("breaches") == 0) & (F.col("n") >= 3), "high").otherwise("medium"),
    })
    return rows.drop("ahead", "last_slot")
