"""Holdings: units, cost, value as of a date, returns; dated exchange rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators._fit import bucket_count


def latest_price(valuations: DataFrame, as_of) -> DataFrame:
    """The last price of each instrument on or before the date."""
    rows = valuations.where(F.col("as_of_date") <= F.lit(as_of).cast("date"))
    return rows.groupBy("instrument_id").agg(F.max_by("price_minor_e4", "as_of_date").alias("price_minor_e4"), F.max("as_of_date").alias("priced_on"))


def holdings(lots: DataFrame, valuations: DataFrame, as_of) -> DataFrame:
    """Per account and instrument: units, cost, value and return; without a price the cost stands in, flagged."""
    held = lots.where(F.col("acquired_at") <= F.lit(as_of).cast("date")).groupBy("account_id", "instrument_id", "currency").agg(F.sum("units_micro").alias("units_micro"), F.sum("cost_minor").alias("cost_minor"))
    both = held.join(latest_price(valuations, as_of), "instrument_id", "left")
    value = F.round(F.col("units_micro").cast("decimal(20,0)") * F.col("price_minor_e4").cast("decimal(17,0)") / F.lit(10**10).cast("decimal(11,0)")).cast("bigint")
    both = both.withColumn("value_minor", F.coalesce(value, "cost_minor")).withColumn("unpriced", F.col("price_minor_e4").isNull())
    gain = F.col("value_minor") - F.col("cost_minor")
    return both.select("account_id", "instrument_id", "currency", "units_micro", "cost_minor", "value_minor", "priced_on", "unpriced", gain.alias("gain_minor"), F.when(F.col("cost_minor") != 0, gain / F.col("cost_minor")).alias("simple_return"))


def convert(rows: DataFrame, rates: DataFrame, day: str, minor: str) -> DataFrame:
    """usd_minor by the rate of that day or the last before it, with the rate and its date; null where there is none.

    Only the distinct days of the rows meet the rates in order, at most one row for each currency and day; the rows
    then join by equality, so a currency with most of the rows is no range join.
    """
    days = rows.select(F.col("currency"), F.col(day).alias("__day")).where("currency IS NOT NULL AND __day IS NOT NULL").distinct()
    told = rates.select("currency", F.col("rate_date").alias("__day"), F.struct("rate_date", "inr_per_usd_e4").alias("__rate"))
    known = days.withColumn("__rate", F.lit(None).cast(told.schema["__rate"].dataType)).unionByName(told).groupBy("currency", "__day").agg(F.max("__rate").alias("__rate"))
    before = Window.partitionBy("currency").orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("__rate", F.last("__rate", ignorenulls=True).over(before)).select(F.col("currency").alias("__c"), "__day", "__rate.*")
    both = rows.join(known, (F.col("currency") == F.col("__c")) & (F.col(day) == F.col("__day")), "left").drop("__c", "__day")
    return both.withColumn("usd_minor", F.when(F.col("currency") == "USD", F.col(minor)).otherwise(F.round(F.col(minor).cast("decimal(20,0)") * 10000 / F.col("inr_per_usd_e4").cast("decimal(17,0)")).cast("bigint")))


def _rates(keys: np.ndarray, years: np.ndarray, flows: np.ndarray) -> np.ndarray:
    """Yearly rates at which each group's flows are worth nothing, by bisection over all groups at once; none: nan."""
    n = int(keys.max()) + 1
    worth = lambda r: np.bincount(keys, flows / np.power(1 + r[keys], years), n)
    low, high = np.full(n, -0.9999), np.full(n, 1.0)
    for _ in range(60):
        wide = (np.sign(worth(low)) == np.sign(worth(high))) & (high < 1e6)
        if not wide.any():
            break
        high[wide] *= 2
    bad = np.sign(worth(low)) == np.sign(worth(high))
    side = np.sign(worth(low))
    for _ in range(100):
        middle = (low + high) / 2
        left = np.sign(worth(middle)) == side
        low, high = np.where(left, middle, low), np.where(left, high, middle)
    return np.where(bad, np.nan, (low + high) / 2)


def xirr(flows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate: money-weighted yearly return of dated flows (on, amount_minor); null without a change of sign.

    Flows of one day are added first, so a group has at most one row for each day.
    """
    days = flows.groupBy(*keys, "on").agg(F.sum("amount_minor").alias("amount_minor")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(bucket_count(flows))))
    kinds = ", ".join(f"{k} {dict(flows.dtypes)[k]}" for k in keys)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        group = part.groupby(keys, sort=False).ngroup().to_numpy()
        day = pd.to_datetime(part["on"]).to_numpy().astype("datetime64[D]").astype(float)
        first = np.full(group.max() + 1, np.inf)
        np.minimum.at(first, group, day)
        found = _rates(group, (day - first[group]) / 365.0, part["amount_minor"].to_numpy(float))
        out = part[keys].assign(g=group).drop_duplicates("g")
        return out.assign(rate=found[out["g"]]).drop(columns="g")

    rows = days.groupBy("bucket").applyInPandas(run, f"{kinds}, rate double")
    return rows.withColumn("rate", F.when(~F.isnan("rate"), F.col("rate")))
