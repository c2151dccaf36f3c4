"""Calendar columns: real dates, business days, cadences. Today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots that one recurrence expands to at most.
MOST_OCCURRENCES = 4000


def parse_iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


# Fixed value: day, month and year of a date written with slashes, dashes or dots.
SLASH_DATE = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2}|\d{4})$"


def parse_slash_date(text: Column, order: str | Column) -> Column:
    """Slashes, dashes or dots; MDY or DMY as told; two-digit years are 20xx; impossible dates are null."""
    part = F.split(F.trim(text), "[/.-]")
    by_month = F.lit(order == "MDY") if isinstance(order, str) else order == "MDY"
    month, day = F.when(by_month, F.get(part, 0)).otherwise(F.get(part, 1)), F.when(by_month, F.get(part, 1)).otherwise(F.get(part, 0))
    year = F.lpad(F.get(part, 2), 4, "20")
    return F.when(F.trim(text).rlike(SLASH_DATE), F.try_to_date(F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def utc_date(instant: Column) -> Column:
    return F.to_date(instant)


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def weekday(day: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(day) - 1


def last_business_day(day: Column) -> Column:
    """The last Monday to Friday of the day's month; no holidays."""
    end = F.last_day(day)
    return F.date_sub(end, F.when(F.dayofweek(end) == 7, 1).when(F.dayofweek(end) == 1, 2).otherwise(0))


def add_months_clamped(day: Column, n: Column) -> Column:
    return F.add_months(day, n)


def with_day_spine(df: DataFrame, from_: Column, to: Column, name: str = "day") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(from_, to)))


def date_tolerance(kind: Column, interval: Column) -> Column:
    return F.when(kind == "weekly", F.when(interval == 1, 1).otherwise(2)).when(kind == "semi_monthly", 2).otherwise(3)


def describe_cadence(kind: Column, interval: Column, second_day: Column) -> Column:
    every = lambda one, many: F.when(interval == 1, one).otherwise(F.format_string(f"every %d {many}", interval))
    return (
        F.when(kind == "weekly", every("weekly", "weeks"))
        .when(kind == "monthly", every("monthly", "months"))
        .when(kind == "last_business_day", F.concat(F.lit("last business day, "), every("monthly", "months")))
        .otherwise(F.concat(F.lit("semi-monthly, second day "), second_day))
    )


def valid_cadence(kind: Column, interval: Column, second_day: Column, anchor: Column) -> Column:
    """Known kind, positive interval, and for semi_monthly a later second day (last_business_day or 2..31) than the anchor's."""
    second = second_day.try_cast("int")
    semi = (second_day == "last_business_day") & (anchor <= last_business_day(anchor)) | second.between(2, 31) & (F.dayofmonth(anchor) < second)
    return F.coalesce(F.when(kind.isin("weekly", "monthly", "last_business_day"), interval >= 1).when(kind == "semi_monthly", semi), F.lit(False))


def expand_occurrences(recurrences: DataFrame, from_: Column, to: Column) -> DataFrame:
    """The rows of ``recurrences`` (kind, interval, second_day, anchor, ...) once for each slot in from_..to: column occurs_on.

    Slots count from the anchor on, clamped to the month's end from the anchor, never step by step;
    equal dates count once. Invalid cadences and slots past ``MOST_OCCURRENCES`` give nothing.
    """
    begin = F.greatest(from_, F.col("anchor"))
    months = F.col("interval") * F.when(F.col("kind") == "semi_monthly", 1).otherwise(F.col("interval") * 0 + 1)
    per = F.when(F.col("kind") == "semi_monthly", 1).otherwise(months)
    first = F.when(F.col("kind") == "weekly", F.floor(F.datediff(begin, "anchor") / (7 * F.col("interval")))).otherwise(F.floor(F.months_between(begin, "anchor") / per) - 1)
    last = F.when(F.col("kind") == "weekly", F.ceil(F.datediff(to, "anchor") / (7 * F.col("interval")))).otherwise(F.ceil(F.months_between(to, "anchor") / per) + 1)
    first = F.greatest(first.cast("int"), F.lit(0))
    steps = F.sequence(first, F.least(last.cast("int"), first + MOST_OCCURRENCES))
    good = valid_cadence(F.col("kind"), F.col("interval"), F.col("second_day"), F.col("anchor")) & (begin <= to) & (last >= first)

    def slots(k: Column) -> Column:
        month = F.add_months(F.col("anchor"), k * per)
        second = F.when(F.col("second_day") == "last_business_day", last_business_day(month)).otherwise(
            F.least(F.last_day(month), F.date_add(F.trunc(month, "month"), F.col("second_day").try_cast("int") - 1))
        )
        return (
            F.when(F.col("kind") == "weekly", F.array(F.date_add(F.col("anchor"), k * 7 * F.col("interval"))))
            .when(F.col("kind") == "monthly", F.array(month))
            .when(F.col("kind") == "last_business_day", F.array(last_business_day(month)))
            .otherwise(F.array(month, second))
        )

    dates = F.array_distinct(F.filter(F.flatten(F.transform(steps, slots)), lambda d: d.between(begin, to)))
    return recurrences.where(good).withColumn("occurs_on", F.explode(dates))


def next_occurrence(recurrences: DataFrame, keys: list[str], on: Column) -> DataFrame:
    """keys, next_on: the first slot on or after a date, within 400 days and an interval."""
    return expand_occurrences(recurrences, on, F.date_add(on, 1200)).groupBy(*keys).agg(F.min("occurs_on").alias("next_on"))


def relative_day(day: Column, today: Column) -> Column:
    n = F.datediff(day, today)
    return F.when(n == 0, "today").when(n == 1, "tomorrow").when(n == -1, "yesterday").when(n > 0, F.format_string("in %d days", n)).otherwise(F.format_string("%d days ago", -n))


def staleness_label(observed: Column, today: Column) -> Column:
    """How old an observation is, in words."""
    age = F.datediff(today, observed)
    return F.when(age < 0, F.concat(F.lit("dated "), F.date_format(observed, "MMM d"), F.lit(", in the future"))).when(age == 0, "observed today").when(age == 1, "observed yesterday").otherwise(F.format_string("observed %d days ago", age))
