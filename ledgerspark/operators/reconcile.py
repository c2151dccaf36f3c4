"""Reconciliation of provisional alerts with authoritative statement lines, one to one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.text import merchant_key
from ledgerspark.sources.scratch import written

#: Candidate pairs that a task looks at together.
CHUNK = 100_000


class ReconcilePlan(NamedTuple):
    matched: DataFrame
    unmatched_alerts: DataFrame
    unmatched_lines: DataFrame


def _candidates(alerts: DataFrame, lines: DataFrame, days: int, ratio: float) -> DataFrame:
    """Pairs with their scores. Days are dealt into spans as long as an alert's window, of which a window meets two at most."""
    span = lambda day: F.floor(F.unix_date(day) / (2 * days + 1))
    a = alerts.select("account_id", "currency", F.col("txn_id").alias("alert"), F.col("posted_at").alias("a_day"), F.col("amount_minor").alias("a_minor"), F.col("descriptor_raw").alias("a_raw"), F.col("region").alias("a_region"))
    b = lines.select("account_id", "currency", F.col("line_id").alias("line"), F.col("posted_at").alias("b_day"), F.col("amount_minor").alias("b_minor"), F.col("descriptor_raw").alias("b_raw"), F.col("region").alias("b_region"))
    spread, b = a.withColumn("on", F.explode(F.sequence(span(F.date_sub("a_day", days)), span(F.date_add("a_day", days))))), b.withColumn("span", span(F.col("b_day")))
    keys = [spread["account_id"] == b["account_id"], spread["currency"] == b["currency"], spread["on"] == b["span"]]
    if ratio == 0:
        keys.append(spread["a_minor"] == b["b_minor"])
    gap, apart = F.abs(F.col("a_minor") - F.col("b_minor")), F.abs(F.datediff("a_day", "b_day"))
    met = spread.join(b, keys).where((apart <= days) & (gap <= F.abs("a_minor") * ratio))
    # equal descriptors have equal merchants, so only others are normalised
    same = F.when((F.col("a_raw") == F.col("b_raw")) & (F.col("a_region") == F.col("b_region")), 0).when(merchant_key(F.col("a_raw"), F.col("a_region")) == merchant_key(F.col("b_raw"), F.col("b_region")), 0).otherwise(1)
    return met.select(spread["account_id"], spread["currency"], "alert", "line", "a_day", "b_day", "a_minor", "b_minor", (gap * 1000 + apart * 10 + same).cast("bigint").alias("score"))


#: The order in which pairs are taken.
ORDER = ["score", "a_day", "alert", "b_day", "line"]


def _with_rivals(pairs: DataFrame) -> DataFrame:
    """Pairs with the number of pairs of either side, and whether they are that side's first."""
    first = F.min(F.struct(*ORDER)).alias("first")
    a = pairs.groupBy("alert").agg(first, F.count(F.lit(1)).alias("n_a")).withColumnRenamed("first", "first_a")
    b = pairs.groupBy("line").agg(first, F.count(F.lit(1)).alias("n_b")).withColumnRenamed("first", "first_b")
    own = F.struct(*ORDER)
    return pairs.join(a, "alert").join(b, "line").withColumns({"best_a": own == F.col("first_a"), "best_b": own == F.col("first_b")}).drop("first_a", "first_b")


def _judged(rows: pd.DataFrame) -> pd.DataFrame:
    """What can be said of a chunk's pairs: taken, dropped, or open where pairs outside it may come first."""
    rows = rows.sort_values(ORDER, kind="stable")
    a, b = (pd.factorize(rows[c])[0] for c in ("alert", "line"))
    unsure_a = (rows["n_a"] > rows.groupby("alert")["alert"].transform("size")).groupby(a).any().tolist()
    unsure_b = (rows["n_b"] > rows.groupby("line")["line"].transform("size")).groupby(b).any().tolist()
    gone_a, gone_b, verdict = set(), set(), []
    for x, y, first_a, first_b in zip(a.tolist(), b.tolist(), rows["best_a"].tolist(), rows["best_b"].tolist(), strict=True):
        if x in gone_a or y in gone_b:
            verdict.append("dropped")
        elif (first_a or not unsure_a[x]) and (first_b or not unsure_b[y]):
            gone_a.add(x)
            gone_b.add(y)
            verdict.append("taken")
        else:
            unsure_a[x] = unsure_b[y] = True  # a later pair of either side waits for this one
            verdict.append("open")
    return rows.assign(verdict=verdict)


def _chunks(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            for low in range(0, len(frame), size):
                held.append(frame.iloc[low : low + size])
                n += len(held[-1])
                if n >= size:
                    yield _judged(pd.concat(held))
                    held, n = [], 0
        if n:
            yield _judged(pd.concat(held))

    return run


def reconcile(alerts: DataFrame, lines: DataFrame, window_days: int = 4, amount_drift_ratio: float = 0.0, chunk: int = CHUNK) -> ReconcilePlan:
    """Greedy one-to-one matches in the order of score, alert (posted_at, txn_id), line (posted_at, line_id).

    Candidates agree in account and currency, lie at most ``window_days`` apart and differ by at most the
    ratio of the alert. Score: 1000 for each minor unit, 10 for each day, 1 for another merchant.

    Pairs are decided in rounds. A pair that comes first on both its sides is taken by any greedy pass; pairs whose
    sides have no other never leave the JVM. The others are dealt by ranges of account and day, whatever the account,
    and a task decides in order what no pair outside its chunk can change; the rest meets in the next round in other
    chunks. Every round takes at least the first pair that is left, and a chunk decides whole chains, so the rounds are few.
    """
    pairs = written(_candidates(alerts, lines, window_days, amount_drift_ratio), "pairs")
    key = ["account_id", "currency", *(["a_minor"] if amount_drift_ratio == 0 else []), "a_day", "alert", "line"]
    taken, rounds = [], 0
    while not pairs.isEmpty():
        rivals = written(_with_rivals(pairs), "rivals")
        alone = (F.col("n_a") == 1) & (F.col("n_b") == 1)
        taken.append(rivals.where(alone).select("account_id", "currency", "alert", "line", "score"))
        others = rivals.where(~alone)
        if others.isEmpty():
            break
        judged = others.repartitionByRange(*key) if rounds % 2 == 0 else others.repartitionByRange(*reversed(key))
        judged = judged.sortWithinPartitions(*key).mapInPandas(_chunks(chunk), judged.schema.add("verdict", "string"))
        done = written(judged.select(*pairs.columns, "verdict").where("verdict <> 'dropped'"), "judged")
        taken.append(done.where("verdict = 'taken'").select("account_id", "currency", "alert", "line", "score"))
        left = done.where("verdict = 'open'").drop("verdict")
        pairs, rounds = written(left.join(taken[-1].select("alert"), "alert", "left_anti").join(taken[-1].select("line"), "line", "left_anti"), "pairs"), rounds + 1
    empty = alerts.sparkSession.createDataFrame([], "account_id string, currency string, alert string, line string, score bigint")
    matched = reduce(DataFrame.unionByName, taken, empty)
    left_a = alerts.join(matched.select(F.col("alert").alias("txn_id")), "txn_id", "left_anti")
    left_b = lines.join(matched.select(F.col("line").alias("line_id")), "line_id", "left_anti")
    return ReconcilePlan(matched, left_a, left_b)
