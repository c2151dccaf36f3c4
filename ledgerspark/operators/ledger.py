"""Reads of the ledger: slices, latest statements, account views, duplicates, supersession."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger_order(ledger: DataFrame) -> list[Column]:
    """The latest first: by day, by the time of entry where the table has it, by id."""
    entered = [F.desc("created_at")] if "created_at" in ledger.columns else []
    return [F.desc("posted_at"), *entered, F.asc("txn_id")]


def ledger_slice(ledger: DataFrame, accounts: DataFrame | None = None, from_=None, to=None, include_superseded: bool = False, limit: int | None = None) -> DataFrame:
    """Rows of the accounts (account_id) inside the dates, both ends included; live rows unless told; with a limit, the latest."""
    if not include_superseded and "superseded_by" in ledger.columns:
        ledger = ledger.where("superseded_by IS NULL")
    if from_ is not None:
        ledger = ledger.where(F.col("posted_at") >= F.lit(from_).cast("date"))
    if to is not None:
        ledger = ledger.where(F.col("posted_at") <= F.lit(to).cast("date"))
    if accounts is not None:
        ledger = ledger.join(accounts.select("account_id").distinct(), "account_id", "left_semi")
    return ledger if limit is None else ledger.orderBy(*ledger_order(ledger)).limit(limit)


def superseded(ledger: DataFrame, by: Column | None = None) -> DataFrame:
    return ledger.where(F.col("superseded_by").isNotNull() if by is None else F.col("superseded_by") == by)


def latest_statement(statements: DataFrame, as_of=None) -> DataFrame:
    """The statement with the last period_end of each account; the least id on ties."""
    if as_of is not None:
        statements = statements.where(F.col("period_end") <= F.lit(as_of).cast("date"))
    whole = F.struct(*statements.columns)
    order = F.struct(F.datediff(F.lit("1900-01-01").cast("date"), "period_end"), "statement_id")
    return statements.groupBy("account_id").agg(F.min_by(whole, order).alias("s")).select("s.*")


def account_view(accounts: DataFrame, statements: DataFrame, as_of) -> DataFrame:
    """Accounts with their latest statement: balance 0 and the parameter's date where there is none."""
    last = latest_statement(statements, as_of).select("account_id", F.col("balance_minor").alias("statement_minor"), "minimum_due_minor", "due_date", "period_end")
    return accounts.join(last, "account_id", "left").withColumns({"current_minor": F.coalesce("statement_minor", F.lit(0)), "as_of": F.coalesce("period_end", F.lit(as_of).cast("date"))})


def due_between(statements: DataFrame, from_, to) -> DataFrame:
    return statements.where(F.col("due_date").between(F.lit(from_).cast("date"), F.lit(to).cast("date")))


def active_accounts(accounts: DataFrame, owner: str | None) -> DataFrame:
    return accounts.where(F.col("is_active") & F.col("owner_id").eqNullSafe(F.lit(owner)))


def debt_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.where(~F.col("kind").isin("checking", "savings"))


def recent_transactions(ledger: DataFrame, limit: int = 20) -> DataFrame:
    """The latest ``limit`` rows of all, from at most twice as many of each account."""
    own = Window.partitionBy("account_id").orderBy(*ledger_order(ledger))
    return ledger.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= 2 * limit).drop("rank").orderBy(*ledger_order(ledger)).limit(limit)


def first_of(df: DataFrame, keys: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """First row of each key, and the others."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank"), ranked.where("__rank > 1").drop("__rank")


def suspected_duplicates(ledger: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Rows whose content stands under several provenances: for review, never for identity."""
    several = ledger.groupBy(fingerprint).agg(F.countDistinct("source", "source_ref").alias("n")).where("n > 1")
    return ledger.join(several.select(fingerprint), fingerprint, "left_semi")


def live_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("account_id").agg(F.count_if(F.col("superseded_by").isNull()).alias("live"), F.count(F.lit(1)).alias("all_rows"))


class Superseded(NamedTuple):
    ledger: DataFrame
    rejects: DataFrame


def apply_supersede(ledger: DataFrame, plan: DataFrame) -> Superseded:
    """Marks plan (txn_id, by) in the ledger; self, unknown, chained or repeated marks are rejected."""
    known = ledger.select(F.col("txn_id").alias("by"), F.col("superseded_by").alias("by_gone"))
    rows = plan.join(ledger.select("txn_id", "superseded_by", F.lit(True).alias("here")), "txn_id", "left").join(known.withColumn("there", F.lit(True)), "by", "left")
    marked = plan.select(F.col("txn_id").alias("by"), F.lit(True).alias("also_marked")).distinct()
    repeated = plan.groupBy("txn_id").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(marked, "by", "left").join(repeated, "txn_id")
    reason = (
        F.when(F.col("txn_id") == F.col("by"), "self")
        .when(F.col("here").isNull() | F.col("there").isNull(), "unknown")
        .when(F.col("by_gone").isNotNull() | F.col("also_marked").isNotNull(), "chained")
        .when(F.col("superseded_by").isNotNull() | (F.col("times") > 1), "repeated")
    )
    judged = rows.select("txn_id", "by", reason.alias("reason"))
    done = judged.where("reason IS NULL").select("txn_id", F.col("by").alias("__by"))
    marked_ledger = ledger.join(done, "txn_id", "left").withColumn("superseded_by", F.coalesce("superseded_by", "__by")).drop("__by")
    return Superseded(marked_ledger, judged.where("reason IS NOT NULL"))


def covering_statement(ledger: DataFrame, statements: DataFrame) -> DataFrame:
    """Transactions with the statements of their account whose period covers them.

    A period stands once in every month that it touches, so rows meet the periods of their account and month by equality.
    """
    first = lambda c: F.trunc(c, "month")
    s = statements.where("period_start <= period_end").select("statement_id", F.col("account_id").alias("__a"), "period_start", "period_end")
    s = s.withColumn("__month", F.explode(F.sequence(first("period_start"), first("period_end"), F.expr("INTERVAL 1 MONTH"))))
    met = (F.col("account_id") == F.col("__a")) & (first("posted_at") == F.col("__month")) & F.col("posted_at").between(F.col("period_start"), F.col("period_end"))
    return ledger.join(s, met, "left").drop("__a", "__month", "period_start", "period_end")


def with_alias_merchant(ledger: DataFrame, merchants: DataFrame, aliases: DataFrame) -> DataFrame:
    """merchant_id from (region, merchant_key) or else an alias (region, alias, merchant_id, origin); a user's correction wins."""
    rank = F.when(F.col("origin") == "user", 0).otherwise(1)
    best = aliases.groupBy("region", F.col("alias").alias("merchant_key")).agg(F.min_by("merchant_id", F.struct(rank, "merchant_id")).alias("by_alias"), F.min(rank).alias("rank"))
    named = merchants.select("region", "merchant_key", F.col("merchant_id").alias("by_key"))
    both = ledger.join(named, ["region", "merchant_key"], "left").join(best, ["region", "merchant_key"], "left")
    return both.withColumn("merchant_id", F.when(F.col("rank") == 0, F.col("by_alias")).otherwise(F.coalesce("by_key", "by_alias"))).drop("by_key", "by_alias", "rank")


def lookup(rows: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values: by id, by dedupe key, by account and period."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def needs_recategorising(ledger: DataFrame, version: int) -> DataFrame:
    """Rows that no category version has touched, or an earlier one."""
    return ledger.where(F.col("category_version").isNull() | (F.col("category_version") < version))


def latest_balance(observations: DataFrame) -> DataFrame:
    """account_id, currency, balance_minor, observed_on of each account's last observation; the least balance on ties."""
    order = F.struct(F.datediff(F.lit("1900-01-01").cast("date"), "observed_on"), "balance_minor")
    last = F.min_by(F.struct("balance_minor", "observed_on"), order).alias("last")
    return observations.groupBy("account_id", "currency").agg(last).select("account_id", "currency", "last.*")


def account_order() -> list[Column]:
    """Active accounts first, then by name and id."""
    return [F.desc("is_active"), F.asc("display_name"), F.asc("account_id")]


def listed_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.orderBy(*account_order())


def upcoming_bills(statements: DataFrame, as_of) -> DataFrame:
    """Statements that fall due on the day or later, the next first."""
    return statements.where(F.col("due_date") >= F.lit(as_of).cast("date")).orderBy("due_date", "statement_id")


def deactivated(accounts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accounts with those of ``ids`` (account_id) inactive, and the ids that no account has. Repeating it changes nothing."""
    gone = ids.select("account_id").distinct()
    changed = accounts.join(gone.withColumn("__gone", F.lit(True)), "account_id", "left")
    changed = changed.withColumn("is_active", F.when(F.col("__gone"), F.lit(False)).otherwise(F.col("is_active"))).drop("__gone")
    return changed, gone.join(accounts.select("account_id"), "account_id", "left_anti")


def marked_parsed(statements: DataFrame, ids: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """Statements with those of ``ids`` (statement_id) marked as parsed at a time (the first mark stays), and the unknown ids."""
    done = ids.select("statement_id").distinct()
    changed = statements.join(done.withColumn("__done", F.lit(at).cast("timestamp")), "statement_id", "left")
    changed = changed.withColumn("parsed_at", F.coalesce("parsed_at", "__done")).drop("__done")
    return changed, done.join(statements.select("statement_id"), "statement_id", "left_anti")
