"""Detectors: plans over shared inputs that give insights with their evidence.

A detector is a function of ``Inputs`` that returns ``insight_id, insight_kind, text`` and
``insight_id, kind, evidence_id, ordinal``. Detectors only declare plans; ``detect`` unions them and
keeps insights that cite something. Ids hash the detector and what it speaks of, so that a second
run gives the same insight the same id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.identity import hash_parts
from ledgerspark.functions.money import to_decimal_string
from ledgerspark.operators import insights


class Inputs(NamedTuple):
    """What detectors read: fees (``reports.fee_evidence``), price steps and their evidence, collisions and their events."""

    fees: DataFrame
    steps: DataFrame
    step_evidence: DataFrame
    collisions: DataFrame
    collision_events: DataFrame


class Found(NamedTuple):
    insights: DataFrame
    evidence: DataFrame
    rejects: DataFrame


Detector = Callable[[Inputs], tuple[DataFrame, DataFrame]]
DETECTORS: dict[str, Detector] = {}


def detector(name: str):
    """Registers a detector; names are unique."""

    def register(f: Detector) -> Detector:
        if name in DETECTORS:
            raise ValueError(f"detector {name} is registered already")
        DETECTORS[name] = f
        return f

    return register


def _id(name: str, *parts: str) -> Column:
    return hash_parts(F.lit(name), *(F.col(p) for p in parts))


@detector("fees")
def fees(given: Inputs) -> tuple[DataFrame, DataFrame]:
    """What fees of one type cost an owner."""
    key = ["owner_id", "currency", "fee_type"]
    rows = given.fees.withColumn("insight_id", _id("fees", *key))
    sums = rows.groupBy("insight_id", *key).agg(F.sum("fee_minor").alias("fee_minor"), F.count(F.lit(1)).alias("n"))
    text = F.concat(F.col("n").cast("string"), F.lit(" times "), "fee_type", F.lit(" cost "), to_decimal_string(F.col("fee_minor"), F.col("currency")), F.lit(" "), "currency")
    order = F.datediff("posted_at", F.lit("1970-01-01").cast("date"))
    return sums.select("insight_id", F.lit("fees").alias("insight_kind"), text.alias("text")), rows.select("insight_id", F.lit("transaction").alias("kind"), F.col("txn_id").alias("evidence_id"), order.alias("ordinal"))


@detector("price_step")
def price_step(given: Inputs) -> tuple[DataFrame, DataFrame]:
    """A recurring charge that became dearer."""
    key = ["stream_key", "effective_from"]
    rows = given.steps.where("direction = 'increase'").withColumn("insight_id", _id("price_step", *key))
    amount = lambda c: to_decimal_string(F.col(c), F.col("currency"))
    text = F.concat("stream_key", F.lit(" went from "), amount("previous_minor"), F.lit(" to "), amount("new_minor"), F.lit(" "), "currency")
    cited = given.step_evidence.withColumn("insight_id", _id("price_step", *key)).select("insight_id", F.lit("transaction").alias("kind"), F.col("txn_id").alias("evidence_id"), "ordinal")
    return rows.select("insight_id", F.lit("price_step").alias("insight_kind"), text.alias("text")), cited.join(rows.select("insight_id"), "insight_id", "left_semi")


@detector("collision")
def collision(given: Inputs) -> tuple[DataFrame, DataFrame]:
    """Days on which an account falls below its floor."""
    key = ["account_id", "from_day"]
    text = F.concat("account_id", F.lit(" is short of "), F.col("shortfall_minor").cast("string"), F.lit(" from "), F.col("from_day").cast("string"))
    rows = given.collisions.select(_id("collision", *key).alias("insight_id"), F.lit("collision").alias("insight_kind"), text.alias("text"))
    kind = F.when(F.col("obligation"), "obligation").otherwise("recurring")
    return rows, given.collision_events.select(_id("collision", *key).alias("insight_id"), kind.alias("kind"), F.concat_ws(":", "account_id", "id", F.col("day").cast("string")).alias("evidence_id"), "ordinal")


def detect(given: Inputs, names: list[str] | None = None) -> Found:
    """Insights of the detectors (all, unless named) that cite something, their distinct evidence, and those that cite nothing."""
    runs = [DETECTORS[name](given) for name in names or sorted(DETECTORS)]
    union = lambda i: reduce(DataFrame.unionByName, (r[i] for r in runs))
    evidence = insights.distinct_evidence(union(1))
    good, bad = insights.checked(union(0), evidence)
    return Found(good, evidence.join(good.select("insight_id"), "insight_id", "left_semi"), bad.select("insight_id", F.lit("no_evidence").alias("reason")))
