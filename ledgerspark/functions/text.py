"""Text columns: messages to plain text, addresses, descriptors."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions.money import as_map

_SPACES = r"[\s\u00A0\u1680\u2000-\u200D\u2028\u2029\u202F\u205F\u2060\u3000\uFEFF]+"
# What payment processors put before a merchant's name, by region.
PREFIXES = {
    "US": ["SQ *", "SQ*", "TST* ", "TST*", "PY *", "PY*", "PAYPAL *", "PAYPAL*", "DD *", "DD*", "CLOVER *", "CLV*", "TOAST*", "SP ", "SP*", "IC* ", "WPY*", "GUMROAD*", "STRIPE*", "SHOPIFY*"],
    "IN": ["UPI/", "UPI-", "POS ", "ATW ", "ACH/", "NEFT/", "IMPS/", "RTGS/", "RAZ", "PAY*", "PAYU*", "BILLDESK*", "CCAVENUE*"],
}
# Whole descriptors and single words that stand for a merchant.
PHRASES = {"amzn mktp us": "amazon marketplace", "amzn mktp": "amazon marketplace", "dreamplug paytech sol": "cred", "mcdonald s": "mcdonalds"}
WORDS = {"wholefds": "whole foods", "sbux": "starbucks", "amzn": "amazon"}


def strip_html(text: Column) -> Column:
    """Script, style, head blocks, comments and tags become spaces."""
    for pattern in (r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES, " "))


_ENTITY = r"(?i)&(#x?[0-9a-f]+|[a-z]+);"
# The named entities that messages are decoded for.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "-", "mdash": "-", "rsquo": "'", "lsquo": "'", "ldquo": '"', "rdquo": '"'}


def _entity(name: Column) -> Column:
    """What one entity stands for; the entity itself where it is unknown or no character."""
    low = F.lower(name)
    hexadecimal, decimal = (F.regexp_extract(low, p, 1) for p in ("^#x0*([0-9a-f]{1,6})$", r"^#0*(\d{1,7})(?!\d)"))
    code = F.when(hexadecimal != "", F.conv(F.nullif(hexadecimal, F.lit("")), 16, 10).cast("int")).when(decimal != "", F.nullif(decimal, F.lit("")).cast("int"))
    known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code)), 8, "0")), "UTF-32")
    return F.coalesce(char, as_map(ENTITIES)[low], F.concat(F.lit("&"), name, F.lit(";")))


def decode_entities(text: Column) -> Column:
    """One pass over named and numeric entities."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1)), _entity)
    pieces = F.zip_with(F.split(text, _ENTITY), found, lambda piece, entity: F.concat(piece, F.coalesce(entity, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def message_text(subject: Column, text: Column, html_: Column) -> Column:
    """Subject and body; a plain body is preferred to HTML."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    body = F.coalesce(blank(text), decode_entities(strip_html(html_)))
    return collapse_whitespace(F.concat_ws(" ", blank(subject), body))


def parse_from_header(header: Column) -> Column:
    """The bare lower-case address, from the last angle group; null where it cannot be read."""
    s = F.trim(header)
    angled = F.regexp_extract(s, r"<([^<>]*)>\s*$", 1)
    address = F.lower(F.trim(F.when(s.rlike(r"<[^<>]*>\s*$"), angled).otherwise(s)))
    return F.when(address.rlike(r"^[^\s<>,;]+@[^\s<>,;@]*\.[^\s<>,;@]*$"), address)


def local_part(address: Column) -> Column:
    return F.regexp_extract(address, r"^(.*)@[^@]*$", 1)


def domain_part(address: Column) -> Column:
    return F.substring_index(address, "@", -1)


# How messages write an account's last four digits, in the order in which they are looked for.
LAST4 = (r"(?i)\bending (?:in|with) (\d{4})\b", r"(?i)\bending (\d{4})\b", r"(?i)\bx{2,}[-\s]?(\d{4})\b", r"\(\.{3}(\d{4})\)")
# What is taken out of a descriptor, in this order: reference suffixes, numbers, company forms, other characters.
NOISE = (r"[*#]\s*\w*\d\w*\s*$", r"\b\d{3,}\b", r"\b(?:llc|inc|ltd|pvt|private|limited|corp|co)\b", "[^a-z0-9]+")


def find_last4(text: Column) -> Column:
    found = (F.regexp_extract(text, p, 1) for p in LAST4)
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found))


def field(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in there."""
    return F.get(F.transform(F.array(value), use), 0)


def _named_part(s: Column) -> Column:
    """The first part between slashes that is no number; the whole where there is none."""
    return F.coalesce(F.get(F.filter(F.split(s, "/"), lambda p: (F.trim(p) != "") & ~F.trim(p).rlike(r"^\d+$")), 0), s)


def _spelled(s: Column) -> Column:
    """The merchant that a phrase stands for, or the words with those replaced that stand for others."""
    words = F.array_join(F.transform(F.split(s, " "), lambda w: F.coalesce(F.element_at(as_map(WORDS), w), w)), " ")
    return F.coalesce(F.element_at(as_map(PHRASES), s), words)


def normalize_descriptor(raw: Column, region: Column) -> Column:
    """A stable merchant string of [a-z0-9 ]; empty when nothing is left."""
    s = whole = F.trim(raw)
    for name, prefixes in PREFIXES.items():
        pattern = "(?i)^(?:" + "|".join(re.escape(p) for p in sorted(prefixes, key=len, reverse=True)) + ")"
        s = F.when(region == name, F.regexp_replace(whole, pattern, "")).otherwise(s)
    s = _let(s, lambda s: F.when((region == "IN") & s.contains("/"), _named_part(s)).otherwise(s))
    s = F.lower(F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2"))
    for pattern in NOISE:
        s = F.regexp_replace(s, pattern, " ")
    return _let(F.trim(F.regexp_replace(s, " +", " ")), _spelled)


def merchant_key(raw: Column, region: Column) -> Column:
    """The normalised descriptor, or a marked raw one; never empty."""
    return _let(normalize_descriptor(raw, region), lambda n: F.when(n == "", F.concat(F.lit("~raw:"), F.lower(F.trim(raw)))).otherwise(n))
