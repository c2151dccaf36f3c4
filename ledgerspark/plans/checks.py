"""Queries of orders, as ranks, and of rules, on rows of the tables that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions import calendar as cal
from ledgerspark.functions import money
from ledgerspark.operators import cashflow, debt, quality
from ledgerspark.operators import ledger as books
from ledgerspark.plans import adapters as view
from ledgerspark.plans.adapters import ACCOUNTS, AS_OF, LEDGER, LOTS, STATEMENTS
from ledgerspark.plans.queries import _DEBT, _debts, query


def _broken(df: DataFrame, rules, *ids: str) -> DataFrame:
    return quality.check_rows(df, rules).select(*ids, F.array_join("broken", ",").alias("broken"))


def _sql_broken(rules: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({rule}, false) THEN '{name}' END" for name, rule in rules.items()) + ")"


def _faults(table: str, ids: str, rules: dict[str, str]) -> str:
    return f"SELECT {ids}, {_sql_broken(rules)} AS broken FROM {table} WHERE {_sql_broken(rules)} <> ''"


_SAFE = 2**53 - 1


@query(f"""WITH {LEDGER}, entered AS (SELECT account_id, txn_id, posted_at, k % 3 AS created_at FROM ledger), doubled AS (SELECT * FROM entered UNION ALL SELECT account_id, 'B' || txn_id, posted_at, created_at FROM entered UNION ALL SELECT account_id, 'C' || txn_id, posted_at, created_at + 1 FROM entered)
  SELECT account_id, txn_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY posted_at DESC, created_at DESC, txn_id) AS INTEGER) AS rank FROM doubled""")
def ledger_order(spark, sf):
    """Every account's rows, the latest first; rows of one day are told apart by their entry, then by id."""
    rows = view.ledger(spark, sf).selectExpr("account_id", "txn_id", "posted_at", "k % 3 AS created_at")
    rows = rows.unionByName(rows.withColumn("txn_id", F.concat(F.lit("B"), "txn_id"))).unionByName(rows.withColumns({"txn_id": F.concat(F.lit("C"), "txn_id"), "created_at": F.col("created_at") + 1}))
    return rows.select("account_id", "txn_id", F.row_number().over(Window.partitionBy("account_id").orderBy(*books.ledger_order(rows))).alias("rank"))


@query(_DEBT + " SELECT owner_id, account_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY due_on NULLS LAST, account_id) AS INTEGER) AS rank FROM positions")
def debt_order(spark, sf):
    """Every owner's positions, soonest due first, undated last."""
    rows = debt.debt_map(_debts(spark, sf), AS_OF).positions
    return rows.select("owner_id", "account_id", F.row_number().over(Window.partitionBy("owner_id").orderBy(*debt.soonest_first())).alias("rank"))


@query(_DEBT + f" SELECT due_on, account_id, CAST(row_number() OVER (PARTITION BY due_on ORDER BY account_id) AS INTEGER) AS rank FROM debts WHERE due_on BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30")
def calendar_order(spark, sf):
    """Entries of every day of the due calendar, by account."""
    rows = debt.due_calendar(_debts(spark, sf), AS_OF, horizon_days=30).entries
    return rows.select("due_on", "account_id", F.row_number().over(Window.partitionBy("due_on").orderBy("account_id")).alias("rank"))


@query(f"WITH {ACCOUNTS} SELECT owner_id, account_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY is_active DESC, kind, account_id) AS INTEGER) AS rank FROM accounts")
def account_order(spark, sf):
    """Every owner's accounts, active ones first, then by name."""
    rows = view.accounts(spark, sf).withColumn("display_name", F.col("kind"))
    return rows.select("owner_id", "account_id", F.row_number().over(Window.partitionBy("owner_id").orderBy(*books.account_order())).alias("rank"))


@query(_DEBT + """, sure AS (SELECT owner_id, account_id, CASE WHEN statement_minor IS NULL THEN 0 WHEN old THEN 1 ELSE 2 END AS c FROM positions)
  SELECT owner_id, account_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY c, account_id) AS INTEGER) AS rank FROM sure""")
def confidence_order(spark, sf):
    """Every owner's positions, the least certain first."""
    rows = debt.debt_map(_debts(spark, sf), AS_OF).positions
    return rows.select("owner_id", "account_id", F.row_number().over(Window.partitionBy("owner_id").orderBy(money.confidence_rank(F.col("confidence")), "account_id")).alias("rank"))


@query(f"""WITH {LEDGER}, d AS (SELECT txn_id, posted_at, date_diff('day', DATE '1996-06-15', posted_at) AS n FROM ledger)
  SELECT txn_id, CASE WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'tomorrow' WHEN n = -1 THEN 'yesterday' WHEN n > 0 THEN 'in ' || n || ' days' ELSE -n || ' days ago' END AS relative,
    CASE WHEN n > 0 THEN 'dated ' || strftime(posted_at, '%b %-d') || ', in the future' WHEN n = 0 THEN 'observed today' WHEN n = -1 THEN 'observed yesterday' ELSE 'observed ' || -n || ' days ago' END AS staleness FROM d""")
def day_labels(spark, sf):
    """What a day is called on another day."""
    today = F.lit("1996-06-15").cast("date")
    return view.ledger(spark, sf).select("txn_id", cal.relative_day(F.col("posted_at"), today).alias("relative"), cal.staleness_label(F.col("posted_at"), today).alias("staleness"))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * CASE l_linenumber % 4 WHEN 0 THEN 1000000000 WHEN 1 THEN -1 WHEN 2 THEN 0 ELSE 1 END AS a, CASE WHEN l_linenumber = 3 THEN {_SAFE} ELSE CAST(round(l_quantity * 100) AS BIGINT) END AS b, CASE WHEN l_suppkey % 2 = 0 THEN 'USD' ELSE 'INR' END AS c FROM lineitem),
  r AS (SELECT *, abs(a) <= {_SAFE} AS fine FROM p)
  SELECT l_orderkey, l_linenumber, CASE WHEN c = 'USD' AND abs(a + b) <= {_SAFE} THEN a + b END AS added, CASE WHEN c = 'USD' AND abs(a - b) <= {_SAFE} THEN a - b END AS subtracted,
    CASE WHEN fine THEN -a END AS negated, CASE WHEN fine THEN abs(a) END AS magnitude, a = 0 AS zero, a < 0 AS negative FROM r""")
def money_guards(spark, sf):
    """Sums, differences, opposites and magnitudes: null across currencies and outside the safe range."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_linenumber", "CAST(round(l_extendedprice * 100) AS BIGINT) * CASE l_linenumber % 4 WHEN 0 THEN 1000000000 WHEN 1 THEN -1 WHEN 2 THEN 0 ELSE 1 END AS a",
        f"CASE WHEN l_linenumber = 3 THEN {_SAFE} ELSE CAST(round(l_quantity * 100) AS BIGINT) END AS b", "CASE WHEN l_suppkey % 2 = 0 THEN 'USD' ELSE 'INR' END AS c",
    )
    a, b, c, usd = F.col("a"), F.col("b"), F.col("c"), F.lit("USD")
    return rows.select(
        "l_orderkey", "l_linenumber", money.add_minor(a, c, b, usd).alias("added"), money.subtract_minor(a, c, b, usd).alias("subtracted"),
        money.negate_minor(a).alias("negated"), money.abs_minor(a).alias("magnitude"), money.is_zero(a).alias("zero"), money.is_negative(a).alias("negative"),
    )


_BAD_LEDGER = [
    f"CASE WHEN k % 101 = 0 THEN {_SAFE + 1} ELSE amount_minor END AS amount_minor", "CASE WHEN k % 53 = 0 THEN 'US' ELSE currency END AS currency", "CASE WHEN k % 59 = 0 THEN 'sms' WHEN k % 2 = 0 THEN 'statement_pdf' ELSE 'alert' END AS source",
    "CASE WHEN k % 61 = 0 THEN -1 ELSE 0 END AS ordinal", "CASE WHEN k % 67 = 0 THEN NULL ELSE posted_at END AS posted_at", "CASE WHEN (amount_minor < 0) <> (k % 71 = 0) THEN 'debit' ELSE 'credit' END AS direction",
    "CASE WHEN k % 73 = 0 THEN ' ' ELSE descriptor_raw END AS descriptor_raw", "CASE WHEN k % 79 = 0 THEN 1.5 WHEN k % 83 = 0 THEN NULL ELSE 0.5 END AS confidence", "CASE WHEN k % 5 = 0 THEN 's1' END AS statement_id",
    "CASE WHEN k % 89 = 0 THEN txn_id END AS superseded_by", "CASE WHEN k % 97 = 0 THEN -1 ELSE 0 END AS category_version",
]


@query(f"WITH {LEDGER}, bad AS (SELECT txn_id, {', '.join(_BAD_LEDGER)} FROM ledger) " + _faults("bad", "txn_id", {
    "amount_range": f"abs(amount_minor) <= {_SAFE}", "currency": "regexp_full_match(currency, '[A-Za-z]{3}')", "source": "source IN ('alert', 'statement_pdf', 'csv_import', 'manual')", "ordinal": "ordinal >= 0", "posted_at": "posted_at IS NOT NULL",
}))
def transaction_faults(spark, sf):
    """Transactions that break a rule of their row, with the rules."""
    return _broken(view.ledger(spark, sf).selectExpr("txn_id", *_BAD_LEDGER), quality.transaction_rules(), "txn_id")


@query(f"WITH {LEDGER}, bad AS (SELECT txn_id, {', '.join(_BAD_LEDGER)} FROM ledger) " + _faults("bad", "txn_id", {
    "direction": "(direction = 'debit' AND amount_minor <= 0) OR (direction = 'credit' AND amount_minor >= 0)", "descriptor": "trim(descriptor_raw) <> ''", "confidence": "confidence BETWEEN 0 AND 1",
    "statement_ref": "statement_id IS NULL OR source = 'statement_pdf'", "superseded_by": "superseded_by IS NULL OR superseded_by <> txn_id", "category_version": "category_version >= 0",
}))
def provenance_faults(spark, sf):
    """Transactions whose sign, text, confidence or references are wrong."""
    return _broken(view.ledger(spark, sf).selectExpr("txn_id", *_BAD_LEDGER), quality.provenance_rules(), "txn_id")


_BAD_STATEMENT = "CAST(date_part('day', period_end) AS INTEGER)"


@query(f"""WITH {STATEMENTS}, bad AS (SELECT statement_id, CASE WHEN {_BAD_STATEMENT} = 7 THEN period_end + 1 ELSE period_start END AS period_start, period_end, CASE {_BAD_STATEMENT} WHEN 8 THEN period_start - 1 WHEN 9 THEN NULL ELSE due_date END AS due_date,
  CASE {_BAD_STATEMENT} WHEN 10 THEN -1 WHEN 11 THEN balance_minor + 1 ELSE minimum_due_minor END AS minimum_due_minor, balance_minor, CASE WHEN {_BAD_STATEMENT} = 12 THEN '' ELSE currency END AS currency FROM statements) """ + _faults("bad", "statement_id", {
    "period_order": "period_start <= period_end", "due_after_period": "due_date IS NULL OR due_date >= period_start", "minimum": "minimum_due_minor IS NULL OR minimum_due_minor BETWEEN 0 AND balance_minor", "currency": "regexp_full_match(currency, '[A-Za-z]{3}')",
}))
def statement_faults(spark, sf):
    """Statements that break a rule of their row."""
    d = "dayofmonth(period_end)"
    rows = view.statements(spark, sf).selectExpr(
        "statement_id", f"CASE WHEN {d} = 7 THEN date_add(period_end, 1) ELSE period_start END AS period_start", "period_end", f"CASE {d} WHEN 8 THEN date_sub(period_start, 1) WHEN 9 THEN NULL ELSE due_date END AS due_date",
        f"CASE {d} WHEN 10 THEN -1 WHEN 11 THEN balance_minor + 1 ELSE minimum_due_minor END AS minimum_due_minor", "balance_minor", f"CASE WHEN {d} = 12 THEN '' ELSE currency END AS currency",
    )
    return _broken(rows, quality.statement_rules(), "statement_id")


@query(f"WITH {STATEMENTS}, bad AS (SELECT statement_id, minimum_due_minor, currency, CASE WHEN {_BAD_STATEMENT} % 5 = 0 THEN 'EUR' ELSE currency END AS minimum_currency FROM statements) SELECT statement_id FROM bad WHERE minimum_due_minor IS NOT NULL AND minimum_currency <> currency")
def currency_faults(spark, sf):
    """Statements whose minimum is stated in another currency."""
    rows = view.statements(spark, sf).withColumn("minimum_currency", F.expr("CASE WHEN dayofmonth(period_end) % 5 = 0 THEN 'EUR' ELSE currency END"))
    return quality.check_rows(rows, quality.agreeing_currencies()).select("statement_id")


@query(f"""WITH {LOTS}, turned AS (SELECT account_id, instrument_id, CASE WHEN cost_minor % 7 = 0 THEN -units_micro ELSE units_micro END AS units_micro, CASE WHEN cost_minor % 7 = 1 THEN -cost_minor ELSE cost_minor END AS cost_minor,
  CASE WHEN cost_minor % 7 <> 2 THEN acquired_at END AS acquired_at, CASE WHEN cost_minor % 7 = 3 THEN '12' ELSE currency END AS currency FROM lots) """ + _faults("turned", "account_id, instrument_id, units_micro, cost_minor", {"units": "units_micro > 0", "cost": "cost_minor >= 0", "acquired_at": "acquired_at IS NOT NULL", "currency": "regexp_full_match(currency, '[A-Za-z]{3}')"}))
def lot_faults(spark, sf):
    """Lots that break a rule of their row."""
    rows = view.lots(spark, sf).selectExpr(
        "account_id", "instrument_id", "CASE WHEN cost_minor % 7 = 0 THEN -units_micro ELSE units_micro END AS units_micro", "CASE WHEN cost_minor % 7 = 1 THEN -cost_minor ELSE cost_minor END AS cost_minor",
        "CASE WHEN cost_minor % 7 <> 2 THEN acquired_at END AS acquired_at", "CASE WHEN cost_minor % 7 = 3 THEN '12' ELSE currency END AS currency",
    )
    return _broken(rows, quality.lot_rules(), "account_id", "instrument_id", "units_micro", "cost_minor")


_BAD_ACCOUNT = ["account_id", "CASE WHEN apr_bp = 100 THEN 'purse' ELSE kind END AS kind", "CASE WHEN apr_bp = 200 THEN 'USDX' ELSE currency END AS currency", "CASE WHEN apr_bp = 300 THEN '12' WHEN apr_bp = 400 THEN NULL ELSE last4 END AS last4", "CASE WHEN apr_bp = 500 THEN NULL ELSE owner_id END AS owner_id"]


@query(f"WITH {ACCOUNTS}, bad AS (SELECT {', '.join(_BAD_ACCOUNT)} FROM accounts) " + _faults("bad", "account_id", {
    "kind": "kind IN ('checking', 'savings', 'credit_card', 'loan', 'investment')", "currency": "regexp_full_match(currency, '[A-Za-z]{3}')", "last4": "last4 IS NULL OR regexp_full_match(last4, '[0-9]{4}')", "owner": "owner_id IS NOT NULL",
}))
def account_faults(spark, sf):
    """Accounts that break a rule of their row."""
    return _broken(view.accounts(spark, sf).selectExpr(*_BAD_ACCOUNT), quality.account_rules(), "account_id")


_BAD_BUDGET = ["account_id", "balance_minor AS limit_minor", "CASE apr_bp % 500 WHEN 0 THEN '2026-13' WHEN 100 THEN NULL ELSE '2026-12' END AS month", "currency"]


@query(f"WITH {ACCOUNTS}, bad AS (SELECT {', '.join(_BAD_BUDGET)} FROM accounts) " + _faults("bad", "account_id", {"limit": "limit_minor >= 0", "month": "regexp_full_match(month, '[0-9]{4}-(0[1-9]|1[0-2])')", "currency": "regexp_full_match(currency, '[A-Za-z]{3}')"}))
def budget_faults(spark, sf):
    """Budgets that break a rule of their row."""
    return _broken(view.accounts(spark, sf).selectExpr(*_BAD_BUDGET), quality.budget_rules(), "account_id")


_BAD_INSIGHT = ["txn_id AS insight_id", "CASE WHEN k % 11 = 0 THEN 'loud' ELSE 'info' END AS severity", "CASE WHEN k % 13 = 0 THEN '' ELSE 'kind' END AS insight_kind", "CASE WHEN k % 17 = 0 THEN '  ' WHEN k % 19 = 0 THEN NULL ELSE 'title' END AS title", "k % 3 = 0 AS is_dismissed", "CASE WHEN k % 6 = 0 THEN posted_at END AS dismissed_at"]


@query(f"WITH {LEDGER}, bad AS (SELECT {', '.join(_BAD_INSIGHT)} FROM ledger) " + _faults("bad", "insight_id", {"severity": "severity IN ('info', 'warning', 'critical')", "kind": "trim(insight_kind) <> ''", "title": "trim(title) <> ''", "dismissal": "is_dismissed = (dismissed_at IS NOT NULL)"}))
def insight_faults(spark, sf):
    """Insights without severity or text, and dismissals without a time."""
    return _broken(view.ledger(spark, sf).selectExpr(*_BAD_INSIGHT), quality.insight_rules(), "insight_id")


_BAD_DEBT = "account_id, owner_id, currency, balance_minor AS owed_minor, CASE WHEN apr_bp = 100 THEN -1 WHEN apr_bp = 200 THEN balance_minor + 1 ELSE 0 END AS minimum_due_minor, CASE WHEN apr_bp = 300 THEN 10001 ELSE apr_bp END AS apr_bp"


@query(f"""WITH {ACCOUNTS}, bad AS (SELECT {_BAD_DEBT} FROM accounts UNION ALL SELECT {_BAD_DEBT} FROM accounts WHERE apr_bp = 400), judged AS (SELECT *, count(*) OVER (PARTITION BY account_id) AS n FROM bad)
  SELECT account_id, CASE WHEN n > 1 THEN 'duplicate_account' WHEN owed_minor < 0 THEN 'negative_balance' WHEN minimum_due_minor < 0 THEN 'negative_minimum' WHEN minimum_due_minor > owed_minor THEN 'minimum_above_balance' WHEN apr_bp NOT BETWEEN 0 AND 10000 THEN 'apr_out_of_range' END AS reason
  FROM judged WHERE n > 1 OR owed_minor < 0 OR minimum_due_minor < 0 OR minimum_due_minor > owed_minor OR apr_bp NOT BETWEEN 0 AND 10000""")
def debt_rejects(spark, sf):
    """Accounts that the debt map refuses, with the reason."""
    rows = view.accounts(spark, sf).selectExpr(*_BAD_DEBT.split(", "), "CAST(NULL AS DATE) AS due_on", "CAST(NULL AS DATE) AS observed_on", "'high' AS confidence")
    return debt.debt_map(rows.unionByName(rows.where("apr_bp = 400")), AS_OF).rejects


@query(f"""WITH {ACCOUNTS}, asked AS (SELECT *, CASE WHEN apr_bp = 100 THEN 0 WHEN apr_bp = 200 THEN 1096 ELSE 30 END AS horizon FROM accounts WHERE is_active), fine AS (SELECT * FROM asked WHERE horizon BETWEEN 1 AND 1095)
  SELECT account_id, 'request' AS what, account_id AS id, 'horizon' AS reason FROM asked WHERE horizon NOT BETWEEN 1 AND 1095
  UNION ALL SELECT a.account_id, 'obligation', 'o', CASE WHEN f.account_id IS NULL THEN 'unknown_account' WHEN a.apr_bp = 300 THEN 'currency' WHEN a.balance_minor < 0 THEN 'negative' WHEN a.apr_bp = 400 THEN 'duplicate_id' WHEN a.apr_bp = 500 THEN 'minimum_above_amount' END AS reason
  FROM accounts a CROSS JOIN range(0, 2) t(x) LEFT JOIN fine f ON f.account_id = a.account_id WHERE (x = 0 OR a.apr_bp = 400) AND reason IS NOT NULL""")
def cash_flow_rejects(spark, sf):
    """What the cash flow refuses: horizons, unknown accounts, other currencies, negative and repeated obligations."""
    held = view.accounts(spark, sf)
    day = f"DATE'{AS_OF}'"
    requests = held.where("is_active").selectExpr("account_id", f"{day} AS today", "CASE WHEN apr_bp = 100 THEN 0 WHEN apr_bp = 200 THEN 1096 ELSE 30 END AS horizon_days", "CAST(0 AS BIGINT) AS opening_minor", "CAST(0 AS BIGINT) AS floor_minor", "currency", "90 AS max_deferral_days")
    owed = held.selectExpr("account_id", "'o' AS id", f"{day} AS due_on", "balance_minor AS amount_minor", "CASE WHEN apr_bp = 300 THEN 'EUR' ELSE currency END AS currency", "true AS movable", "CAST(NULL AS DATE) AS latest_move_to", "CASE WHEN apr_bp = 500 THEN balance_minor + 1 END AS minimum_due_minor", "'high' AS confidence", "apr_bp")
    return cashflow.project_cash_flow(requests, owed.unionByName(owed.where("apr_bp = 400")).drop("apr_bp")).rejects


@query(f"WITH {STATEMENTS}, first AS (SELECT min(account_id) AS account_id FROM statements) SELECT statement_id, balance_minor FROM statements JOIN first USING (account_id)")
def statements_of_first_account(spark, sf):
    """Statements of the account that comes first by its id."""
    rows = view.statements(spark, sf)
    return books.lookup(rows, account_id=rows.agg(F.min("account_id")).first()[0]).select("statement_id", "balance_minor")
