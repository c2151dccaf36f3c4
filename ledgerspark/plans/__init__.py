"""Registered queries over the driver's tables, and the SQL that checks them."""

from ledgerspark.plans import checks  # noqa: F401
from ledgerspark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
