"""Money as two columns: integer minor units and an ISO-4217 code. No floats are stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal places of currencies that do not have two.
EXPONENTS = {"JPY": 0, "KRW": 0, "VND": 0, "IDR": 0, "CLP": 0, "ISK": 0, "KWD": 3, "BHD": 3, "OMR": 3, "JOD": 3, "TND": 3}
# Absolute amount tolerances of last resort, in minor units.
FLOORS = {"USD": 100, "INR": 1000, "EUR": 100, "GBP": 100, "CAD": 100, "AUD": 100, "SGD": 100}
SAFE = 2**53 - 1


def as_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def valid_currency(code: Column) -> Column:
    return F.coalesce(code.rlike("^[A-Za-z]{3}$"), F.lit(False))


def exponent_of(currency: Column) -> Column:
    return F.coalesce(as_map(EXPONENTS)[F.upper(currency)], F.lit(2))


def parse_amount(text: Column, currency: Column) -> Column:
    """struct(minor, error): parentheses or a minus make it negative; symbols, codes, grouping and white space go; too many decimals are an error, never rounded."""
    s = F.trim(text)
    bracketed = s.rlike(r"^\(.*\)$")
    s = F.when(bracketed, F.regexp_extract(s, r"^\((.*)\)$", 1)).otherwise(s)
    s = F.trim(F.regexp_replace(s, r"(?i)Rs\.?|INR|USD|AUD|SGD|EUR|GBP|[₹$€£¥]", ""))
    minus = s.startswith("-")
    s = F.regexp_replace(F.regexp_replace(s, r"^[-+]", ""), r"[,\s]", "")
    whole, frac = F.regexp_extract(s, r"^(\d*)\.?(\d*)$", 1), F.regexp_extract(s, r"^(\d*)\.?(\d*)$", 2)
    exponent = exponent_of(currency)
    digits = F.concat(F.when(whole == "", "0").otherwise(whole), F.rpad(frac, exponent, "0")).try_cast("bigint")
    error = (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(~valid_currency(currency), "bad_currency")
        .when(~s.rlike(r"^(\d+\.?\d*|\.\d+)$"), "not_a_number")
        .when(F.length(frac) > exponent, "too_many_decimals")
        .when(digits.isNull() | (digits > SAFE), "out_of_range")
    )
    signed = F.when(bracketed != minus, -digits).otherwise(digits)
    return F.struct(F.when(error.isNull(), signed).alias("minor"), error.alias("error"))


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def parse_amounts(texts: Column, currencies: Column) -> Column:
    """``parse_amount`` of every text of an array that is there, each in its currency; null stays null."""
    return F.zip_with(texts, currencies, lambda text, currency: F.when(text.isNotNull(), let(F.struct(text.alias("t"), currency.alias("c")), lambda x: parse_amount(x["t"], x["c"]))))


def to_decimal_string(minor: Column, currency: Column) -> Column:
    exponent = exponent_of(currency)
    digits = F.abs(minor).cast("string")
    digits = F.lpad(digits, F.greatest(F.length(digits), exponent + 1), "0")
    cut = F.length(digits) - exponent
    text = F.when(exponent == 0, digits).otherwise(F.concat(F.substring(digits, F.lit(1), cut), F.lit("."), F.substring(digits, cut + 1, exponent)))
    return F.concat(F.when(minor < 0, "-").otherwise(""), text)


def scale_minor(minor: Column, factor: Column) -> Column:
    """Half away from zero."""
    return F.round(minor.cast("double") * factor).cast("bigint")


def amount_tolerance(expected: Column, floor: Column, rel: float | Column = 0.02) -> Column:
    return F.greatest(F.floor(F.abs(expected) * (F.lit(rel) if isinstance(rel, float) else rel) + 0.5).cast("bigint"), floor)


def within_tolerance(a: Column, b: Column, tolerance: Column) -> Column:
    return F.abs(a - b) <= tolerance


def occurrences_per_year(kind: Column, interval: Column) -> Column:
    return F.when(kind == "weekly", 365.25 / (7 * interval)).when(kind == "semi_monthly", 24.0).otherwise(12.0 / interval)


def format_apr(basis_points: Column) -> Column:
    return F.concat((basis_points / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((basis_points % 100).cast("string"), 2, "0"), F.lit("%"))


def same_currency_sum(minor: str, *currency: str) -> Column:
    """A sum to use only under grouping by the currency; none gives zero."""
    return F.coalesce(F.sum(minor), F.lit(0)).cast("bigint")


def lower_median(minor: Column) -> Column:
    """The element at (n - 1) >> 1, never an average."""
    return F.element_at(F.sort_array(F.collect_list(minor)), (F.floor((F.count(minor) - 1) / 2) + 1).cast("int"))


RANK = {"low": 0, "medium": 1, "high": 2}


def confidence_rank(confidence: Column) -> Column:
    return as_map(RANK)[confidence]


def weakest_confidence(confidence: Column) -> Column:
    """The weakest of a group; of nothing, high."""
    least = F.min(confidence_rank(confidence))
    return F.when(least == 0, "low").when(least == 1, "medium").otherwise("high")


def storable(minor: Column) -> Column:
    """The amount where it lies in the safe range, else null."""
    return F.when(minor.between(-SAFE, SAFE), minor)


def _agreed(of: Column, currency: Column, other: Column) -> Column:
    return F.when(currency == other, of)


def add_minor(a: Column, a_currency: Column, b: Column, b_currency: Column) -> Column:
    """Sum of two amounts of one currency; null where the currencies differ or the sum leaves the safe range."""
    return _agreed(storable(F.try_add(a, b)), a_currency, b_currency)


def subtract_minor(a: Column, a_currency: Column, b: Column, b_currency: Column) -> Column:
    """Difference of two amounts of one currency; null where the currencies differ or it leaves the safe range."""
    return _agreed(storable(F.try_subtract(a, b)), a_currency, b_currency)


def negate_minor(minor: Column) -> Column:
    """The opposite amount; null outside the safe range."""
    return -storable(minor)


def abs_minor(minor: Column) -> Column:
    """The amount without its sign; null outside the safe range."""
    return F.abs(storable(minor))


def is_zero(minor: Column) -> Column:
    return minor == 0


def is_negative(minor: Column) -> Column:
    return minor < 0


def compare_minor(a: Column, a_currency: Column, b: Column, b_currency: Column) -> Column:
    """-1, 0 or 1 for two amounts of one currency; null where the currencies differ."""
    return _agreed(F.when(a < b, -1).when(a > b, 1).when(a == b, 0), a_currency, b_currency)
