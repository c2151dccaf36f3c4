"""Price steps of recurring streams: confirmed levels, steps between them, spikes and pending changes."""

from __future__ import annotations

from bisect import insort
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.money import amount_tolerance, occurrences_per_year, within_tolerance
from ledgerspark.operators._fit import amount_tolerance as tolerance
from ledgerspark.operators._fit import by_group
from ledgerspark.sources.scratch import written


class PriceSteps(NamedTuple):
    levels: DataFrame
    steps: DataFrame
    pending: DataFrame
    outliers: DataFrame
    evidence: DataFrame


def split_levels(amounts: list[int], floor: int, rel: float, least: int) -> list[tuple[str, int, int]]:
    """(role, level number, level amount) of each charge in order: level, outlier or pending."""
    out, run, number = [], [amounts[0]], 0
    out.append(("level", 0))
    levels = {}
    for i in range(1, len(amounts)):
        level, x = run[(len(run) - 1) >> 1], amounts[i]
        if abs(x - level) <= tolerance(level, floor, rel):
            insort(run, x)
            out.append(("level", number))
            continue
        ahead = amounts[i + 1 : i + least]
        if len(ahead) == least - 1 and all(abs(y - x) <= tolerance(x, floor, rel) for y in ahead):
            levels[number] = level
            number, run = number + 1, [x]
            out.append(("level", number))
        else:
            out.append(("pending" if i == len(amounts) - 1 else "outlier", number))
    levels[number] = run[(len(run) - 1) >> 1]
    return [(role, n, levels[n]) for role, n in out]


_OUT = "stream_key string, txn_id string, posted_at date, amount_minor bigint, role string, level int, level_minor bigint"


def _leveled(rel: float, least: int):
    def run(key: tuple, g: pd.DataFrame) -> list[tuple]:
        amounts = g["amount_minor"].tolist()
        found = split_levels(amounts, int(g["floor_minor"].iloc[0]), rel, least)
        return [(*key, t, d, a, role, n, minor) for (role, n, minor), t, d, a in zip(found, g["txn_id"], g["posted_at"], amounts, strict=True)]

    return run


def _taken(part: pd.DataFrame) -> pd.DataFrame:
    """Of the fitting pairs of one stream, those in which a step takes its announcement."""
    part, steps, used, keep = part.sort_values(["effective_from", "a_from", "announcement_id"]), set(), set(), []
    for step, announcement in zip(part["effective_from"], part["announcement_id"], strict=True):
        keep.append(step not in steps and announcement not in used)
        if keep[-1]:
            steps.add(step)
            used.add(announcement)
    return part[keep]


def detect_price_steps(occurrences: DataFrame, streams: DataFrame, announcements: DataFrame | None = None, min_run_length: int = 2, rel: float = 0.02, match_days: int = 10) -> PriceSteps:
    """Levels and steps of each stream.

    ``occurrences``: stream_key, txn_id, posted_at, amount_minor, floor_minor; ``streams``: stream_key, kind, interval, currency;
    ``announcements``: stream_key, id, announced_on, effective_from, new_minor, currency. Steps in their order each take the
    first announcement, by effective_from and id, that fits and that no earlier step has taken. ``evidence`` has the charges
    of the levels before and after each step, in order.
    """
    few = occurrences.select("stream_key", "txn_id", "posted_at", "amount_minor", "floor_minor")
    # levels, steps, pending changes and outliers all come out of these rows
    rows = written(by_group(few, ["stream_key"], ["posted_at", "txn_id"], _leveled(rel, min_run_length), _OUT), "levels")
    levels = rows.where("role = 'level'").groupBy("stream_key", "level").agg(F.first("level_minor").alias("level_minor"), F.min("posted_at").alias("from_day"), F.max("posted_at").alias("to_day"), F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("stream_key").orderBy("level")
    steps = levels.withColumns({"previous_minor": F.lag("level_minor").over(by), "previous_n": F.lag("n").over(by)}).where("previous_minor IS NOT NULL")
    between = steps.select("stream_key", F.col("from_day").alias("effective_from"), F.explode(F.array(F.struct((F.col("level") - 1).alias("level"), F.lit("before").alias("side")), F.struct("level", F.lit("after").alias("side")))).alias("l")).select("stream_key", "effective_from", "l.*")
    told = rows.where("role = 'level'").select("stream_key", "level", "txn_id", "posted_at").join(between, ["stream_key", "level"])
    evidence = told.select("stream_key", "effective_from", "side", "txn_id", F.row_number().over(Window.partitionBy("stream_key", "effective_from").orderBy("posted_at", "txn_id")).alias("ordinal"))
    floors = occurrences.groupBy("stream_key").agg(F.max("floor_minor").alias("floor_minor"))
    terms = streams.select("stream_key", "kind", "interval", "currency").join(floors, "stream_key")
    seen = F.least("previous_n", "n")
    sure = F.when(seen >= 3, "high").when(seen >= 2, "medium").otherwise("low")
    steps = steps.select("stream_key", F.col("from_day").alias("effective_from"), "previous_minor", F.col("level_minor").alias("new_minor"), sure.alias("confidence"), F.lit("observed").alias("source")).join(terms, "stream_key")
    if announcements is not None:
        a = announcements.select("stream_key", F.col("id").alias("announcement_id"), "announced_on", F.col("effective_from").alias("a_from"), F.col("new_minor").alias("a_minor"), F.col("currency").alias("a_currency"))
        close = (F.abs(F.datediff("a_from", "effective_from")) <= match_days) & (F.col("a_currency") == F.col("currency"))
        met = steps.join(a, "stream_key").where(close & within_tolerance(F.col("a_minor"), F.col("new_minor"), amount_tolerance(F.col("new_minor"), F.col("floor_minor"), rel)))
        met = met.select("stream_key", "effective_from", "a_from", "announced_on", "announcement_id")
        met = met.groupBy("stream_key").applyInPandas(_taken, met.schema)  # steps and announcements of one stream that fit each other
        used = met.select("stream_key", "effective_from", "announcement_id", F.datediff("a_from", "announced_on").alias("lead_days"))
        steps = steps.join(used, ["stream_key", "effective_from"], "left").withColumns({
            "source": F.when(F.col("announcement_id").isNotNull(), "observed+announced").otherwise("observed"), "confidence": F.when(F.col("announcement_id").isNotNull(), "high").otherwise(F.col("confidence")),
        })
        last = levels.groupBy("stream_key").agg(F.max_by(F.struct("level_minor", "to_day"), "level").alias("l"))
        ahead = a.join(used.select("stream_key", "announcement_id"), ["stream_key", "announcement_id"], "left_anti").join(last, "stream_key").join(terms, "stream_key")
        ahead = ahead.where("a_currency = currency AND a_from > l.to_day AND a_minor <> l.level_minor").select(
            "stream_key", F.col("a_from").alias("effective_from"), F.col("l.level_minor").alias("previous_minor"), F.col("a_minor").alias("new_minor"), F.lit("high").alias("confidence"),
            F.lit("announced").alias("source"), "kind", "interval", "currency", "floor_minor", "announcement_id", F.datediff("a_from", "announced_on").alias("lead_days"),
        )
        steps = steps.unionByName(ahead)
    delta = F.col("new_minor") - F.col("previous_minor")
    steps = steps.withColumns({
        "delta_minor": delta, "annualised_minor": F.round(delta * occurrences_per_year(F.col("kind"), F.col("interval"))).cast("bigint"),
        "relative": F.when(F.col("previous_minor") != 0, delta / F.col("previous_minor")), "direction": F.when(delta >= 0, "increase").otherwise("decrease"),
    }).drop("floor_minor")
    pending = rows.where("role = 'pending'").select("stream_key", "txn_id", "posted_at", F.col("level_minor").alias("previous_minor"), F.col("amount_minor").alias("observed_minor"), (F.col("amount_minor") - F.col("level_minor")).alias("delta_minor"))
    return PriceSteps(levels, steps, pending, rows.where("role = 'outlier'").select("stream_key", "txn_id", "posted_at", "amount_minor"), evidence)


def annualised_impact(steps: DataFrame) -> DataFrame:
    return steps.groupBy("stream_key", "currency").agg(F.sum("annualised_minor").alias("annualised_minor"))
