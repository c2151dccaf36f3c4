"""Data quality: row rules, uniqueness and references that a file store does not enforce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.money import SAFE, valid_currency


def transaction_rules() -> dict[str, Column]:
    return {
        "amount_range": F.abs("amount_minor") <= SAFE,
        "currency": valid_currency(F.col("currency")),
        "source": F.col("source").isin("alert", "statement_pdf", "csv_import", "manual"),
        "ordinal": F.col("ordinal") >= 0,
        "posted_at": F.col("posted_at").isNotNull(),
    }


def provenance_rules() -> dict[str, Column]:
    """What a stored transaction says of itself: sign and direction, text, confidence, and what it may point at."""
    minor, direction = F.col("amount_minor"), F.col("direction")
    return {
        "direction": ((direction == "debit") & (minor <= 0)) | ((direction == "credit") & (minor >= 0)),
        "descriptor": F.trim("descriptor_raw") != "",
        "confidence": F.col("confidence").between(0, 1),
        "statement_ref": F.col("statement_id").isNull() | (F.col("source") == "statement_pdf"),
        "superseded_by": F.col("superseded_by").isNull() | (F.col("superseded_by") != F.col("txn_id")),
        "category_version": F.col("category_version") >= 0,
    }


def insight_rules() -> dict[str, Column]:
    """Severity, texts, and a dismissal that has its time."""
    return {
        "severity": F.col("severity").isin("info", "warning", "critical"),
        "kind": F.trim("insight_kind") != "",
        "title": F.trim("title") != "",
        "dismissal": F.col("is_dismissed") == F.col("dismissed_at").isNotNull(),
    }


def stream_rules() -> dict[str, Column]:
    return {"seen_order": F.col("first_seen") <= F.col("last_seen"), "amount_range": F.abs("expected_minor") <= SAFE, "currency": valid_currency(F.col("currency")), "status": F.col("status").isin("candidate", "mature", "dormant", "cancelled")}


def statement_rules() -> dict[str, Column]:
    return {
        "period_order": F.col("period_start") <= F.col("period_end"),
        "due_after_period": F.col("due_date").isNull() | (F.col("due_date") >= F.col("period_start")),
        "minimum": F.col("minimum_due_minor").isNull() | F.col("minimum_due_minor").between(0, F.col("balance_minor")),
        "currency": valid_currency(F.col("currency")),
    }


def agreeing_currencies() -> dict[str, Column]:
    """A statement's minimum is stated in the balance's currency."""
    return {"minimum_currency": F.col("minimum_due_minor").isNull() | (F.col("minimum_currency") == F.col("currency"))}


def account_rules() -> dict[str, Column]:
    return {"kind": F.col("kind").isin("checking", "savings", "credit_card", "loan", "investment"), "currency": valid_currency(F.col("currency")), "last4": F.col("last4").isNull() | F.col("last4").rlike(r"^\d{4}$"), "owner": F.col("owner_id").isNotNull()}


def lot_rules() -> dict[str, Column]:
    return {"units": F.col("units_micro") > 0, "cost": F.col("cost_minor") >= 0, "acquired_at": F.col("acquired_at").isNotNull(), "currency": valid_currency(F.col("currency"))}


def budget_rules() -> dict[str, Column]:
    return {"limit": F.col("limit_minor") >= 0, "month": F.col("month").rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), "currency": valid_currency(F.col("currency"))}


def check_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows that break a rule, with the names of the broken ones; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows share; null owners count as one."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_refs(child: DataFrame, parent: DataFrame, fk: str, key: str | None = None) -> DataFrame:
    """Rows whose reference is set and names no row of the parent."""
    names = parent.select(F.col(key or fk).alias(fk)).distinct()
    return child.where(F.col(fk).isNotNull()).join(names, fk, "left_anti")
