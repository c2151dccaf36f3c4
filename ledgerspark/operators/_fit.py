"""Cadence fitting for one group of charges: which calendar rhythm explains them, slot by slot."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The rhythms tried, in the order that settles ties.
CADENCES = (
    ("weekly", 1, None), ("weekly", 2, None), ("semi_monthly", 1, "last_business_day"), ("weekly", 4, None), ("monthly", 1, None),
    ("last_business_day", 1, None), ("monthly", 2, None), ("monthly", 3, None), ("monthly", 6, None), ("monthly", 12, None),
)
_BEGIN = np.arange("1800-01", "2300-02", dtype="datetime64[M]").astype("datetime64[D]").astype(np.int64)
_FIRST, _LAST = _BEGIN[:-1], _BEGIN[1:] - 1
_BUSINESS = _LAST - np.choose((_LAST + 3) % 7, [0, 0, 0, 0, 0, 1, 2])  # Saturdays and Sundays give way to Friday


@lru_cache(maxsize=50_000)
def slots(cadence: tuple, anchor: int, first: int, last: int) -> np.ndarray | None:
    """Days (since 1970) of a cadence from first to last, ascending; None where the anchor cannot start it."""
    kind, step, second = cadence
    begin = max(first, anchor)
    if kind == "weekly":
        return np.arange(anchor - (anchor - begin) // (7 * step) * 7 * step, last + 1, 7 * step)
    month = int(np.searchsorted(_FIRST, anchor, "right")) - 1
    day = anchor - int(_FIRST[month])  # from 0
    if kind == "semi_monthly" and (anchor > _BUSINESS[month] if second == "last_business_day" else day + 1 >= int(second)):
        return None
    months = np.arange(month, int(np.searchsorted(_FIRST, last, "right")), step)
    found = _BUSINESS[months] if kind == "last_business_day" else np.minimum(_FIRST[months] + day, _LAST[months])
    if kind == "semi_monthly":
        other = _BUSINESS[months] if second == "last_business_day" else np.minimum(_FIRST[months] + int(second) - 1, _LAST[months])
        found = np.unique(np.concatenate([found, other]))
    return found[(found >= begin) & (found <= last)]


def tolerance_days(cadence: tuple) -> int:
    return {"weekly": 1 if cadence[1] == 1 else 2, "semi_monthly": 2}.get(cadence[0], 3)


def amount_tolerance(expected: int, floor: int, rel: float) -> int:
    return max(int(abs(expected) * rel + 0.5), floor)


def _windows(days: np.ndarray, cadence: tuple, tol: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Slots of a cadence that begins with the first day, and which of them have a day within tolerance."""
    expected = slots(cadence, int(days[0]), int(days[0]), int(days[-1]))
    return None if expected is None else (expected, np.searchsorted(days, expected + tol, "right") > np.searchsorted(days, expected - tol))


class _Pool:
    """The rows of a group that no stream has, each day's by amount, then id: a slot's row is found by bisection, and no row that is gone is passed again."""

    def __init__(self, days: np.ndarray, amounts: np.ndarray, ids: list[str]):
        self.rows = np.lexsort((amounts, days))  # stable, so rows of one day and amount stay in the order of their ids
        self.costs = amounts[self.rows].tolist()
        self.ids = ids
        self.days, starts = np.unique(days[self.rows], return_index=True)
        self.numbers = {d: k for k, d in enumerate(self.days.tolist())}
        self.edges = [*starts.tolist(), len(days)]
        self.sizes = np.diff(np.array(self.edges))
        self.after = list(range(len(days) + 1))  # a place, or one nearer to the next row that is left

    def next(self, i: int, used: set[int]) -> int:
        """The first place from i on whose row is left and not used."""
        after = self.after
        while True:
            while after[i] != i:
                after[i] = after[after[i]]
                i = after[i]
            if i not in used:
                return i
            i += 1

    def nearest(self, slot: int, tol: int, level: int | None, allowed: int, used: set[int]) -> tuple[int, int, bool] | None:
        """(place, days from the slot, whether its amount is no good) of the least row by distance, amount and id; good amounts come first."""
        other = None
        for gap in range(tol + 1):
            good = None
            for day in (slot - gap, slot + gap) if gap else (slot,):
                k = self.numbers.get(day)
                if k is None or not self.sizes[k]:
                    continue
                a, b = self.edges[k], self.edges[k + 1]
                if level is not None:
                    i = self.next(bisect_left(self.costs, level - allowed, a, b), used)
                    if i < b and self.costs[i] <= level + allowed:
                        good = i if good is None or self._before(i, good) else good
                if other is None or other[1] == gap:
                    i = self.next(a, used)
                    if i < b:
                        other = (i, gap, level is not None) if other is None or self._before(i, other[0]) else other
            if good is not None:
                return good, gap, False
            if level is None and other is not None:
                break
        return other

    def _before(self, i: int, j: int) -> bool:
        if self.costs[i] != self.costs[j]:
            return self.costs[i] < self.costs[j]
        return self.ids[self.rows[i]] < self.ids[self.rows[j]]

    def take(self, places: list[int]) -> None:
        for i in places:
            self.after[i] = i + 1
            self.sizes[bisect_right(self.edges, i) - 1] -= 1


def fit(pool: _Pool, windows: tuple, tol: int, floor: int, rel: float):
    """(matches (place, slot, breach), missed slots, breaches, deviation) or None."""
    expected, near = windows
    used, matches, level, deviation, breaches = set(), [], None, 0, 0
    for slot in expected[near].tolist():
        found = pool.nearest(slot, tol, level, 0 if level is None else amount_tolerance(level, floor, rel), used)
        if found is None:
            continue
        i, gap, breach = found
        matches.append((i, slot, breach))
        breaches += breach
        deviation += gap
        used.add(i)
        level = pool.costs[i]
    if len(matches) < 2:
        return None
    met = {slot for _, slot, _ in matches}
    return matches, [s for s in expected.tolist() if s not in met], breaches, deviation


def peel(days: np.ndarray, amounts: np.ndarray, ids: list[str], floor: int, cadences, rel: float, coherence: float, tol: int | None):
    """Streams one after another: (cadence, anchor, matches with row numbers, missed); then the rows left over. Rows are sorted by day, then id.

    A cadence matches at most one row for each slot that has any row within tolerance. Those with the highest bounds are
    fitted first; one whose bound is below the matches of a coherent fit cannot come before it and is not fitted. A
    stream costs by the days and slots of its group, not by the rows.
    """
    pool, streams, left = _Pool(days, amounts, ids), [], len(days)
    while left >= 2:
        here = pool.days[pool.sizes > 0]
        tried = []
        for k, cadence in enumerate(cadences):
            near = tolerance_days(cadence) if tol is None else tol
            windows = _windows(here, cadence, near)
            if windows is not None:
                tried.append((int(np.count_nonzero(windows[1])), k, cadence, windows, near))
        best = None
        for bound, k, cadence, windows, near in sorted(tried, key=lambda t: (-t[0], t[1])):
            if bound < 2 or (best is not None and bound < -best[0][0]):
                break
            found = fit(pool, windows, near, floor, rel)
            if found and 1 - found[2] / len(found[0]) >= coherence:
                order = (-len(found[0]), len(found[1]), found[2], found[3], k)
                if best is None or order < best[0]:
                    best = order, cadence, found
        if best is None:
            break
        _, cadence, (matches, missed, _, _) = best
        streams.append((cadence, int(here[0]), [(int(pool.rows[i]), s, b) for i, s, b in matches], missed))
        pool.take([i for i, _, _ in matches])
        left -= len(matches)
    return streams, np.sort(pool.rows[np.array([i == j for i, j in enumerate(pool.after[:-1])], bool)])


def by_group(df: DataFrame, keys: list[str], order: list[str], run: Callable[[tuple, pd.DataFrame], list[tuple]], schema: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """``run`` of every group, in order, in tasks that hold one group and one batch at a time.

    The number of partitions is set, as tasks here take time by their Python work, not by their bytes; adaptive
    execution would join small ones.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    columns = [c.split()[0] for c in schema.split(", ")]

    def groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []  # the frames of the last group, joined when it ends
        for frame in frames:
            edges = np.flatnonzero((frame[keys] != frame[keys].shift()).any(axis=1).to_numpy())
            if not len(edges):
                continue
            if held and (held[0][keys].iloc[0] == frame[keys].iloc[0]).all():
                if len(edges) == 1:
                    held.append(frame)
                    continue
                held.append(frame.iloc[: edges[1]])
                edges = edges[1:]
            if held:
                yield whole(pd.concat(held, ignore_index=True), np.array([0, sum(map(len, held))]))
            if len(edges) > 1:
                yield whole(frame, edges)
            held = [frame.iloc[edges[-1] :]]
        if held:
            yield whole(pd.concat(held, ignore_index=True), np.array([0, sum(map(len, held))]))

    def whole(frame: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            g = frame.iloc[a:b]
            out += run(tuple(g[k].iloc[0] for k in keys), g)
        made = pd.DataFrame(out, columns=columns)
        return made.astype(kinds) if kinds else made

    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInPandas(groups, schema)


#: Rows that one Python call gets, about.
ROWS_PER_CALL = 20_000


def bucket_count(rows: DataFrame) -> int:
    """Buckets for grouped Python calls over a table of so many rows: more rows make more buckets, not larger ones."""
    return max(1, -(-rows.count() // ROWS_PER_CALL))
