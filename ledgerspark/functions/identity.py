"""Identity of observations: exact by provenance, and a content fingerprint for suspicion only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_parts(*parts: Column) -> Column:
    """sha256 of length-prefixed parts, so that parts never run into each other."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *(F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text)), 256)


def dedupe_key(source: Column, source_ref: Column, ordinal: Column) -> Column:
    return hash_parts(source, source_ref, ordinal)


def content_fingerprint(account: Column, posted_at: Column, minor: Column, currency: Column, merchant: Column) -> Column:
    return hash_parts(account, posted_at, minor, currency, merchant)
