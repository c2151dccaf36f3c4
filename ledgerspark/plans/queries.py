"""One query per operator of the ledger library, over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import calendar as cal
from ledgerspark.functions import money, text
from ledgerspark.functions.identity import content_fingerprint, dedupe_key
from ledgerspark.operators import cashflow, debt, holdings, ingest, insights, networth, price_steps, quality, reconcile, recurring, reports
from ledgerspark.operators import ledger as books
from ledgerspark.plans import adapters as view
from ledgerspark.plans.adapters import ACCOUNTS, AS_OF, LEDGER, LOTS, STATEMENTS, VALUATIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {LEDGER} SELECT owner_id, currency, strftime(posted_at, '%Y-%m') AS month, CAST(sum(greatest(amount_minor, 0)) AS BIGINT) AS inflow_minor, CAST(sum(greatest(-amount_minor, 0)) AS BIGINT) AS outflow_minor, count(*) AS n FROM ledger GROUP BY ALL")
def monthly_totals(spark, sf):
    return reports.monthly_totals(view.ledger(spark, sf))


@query(f"WITH {STATEMENTS} SELECT statement_id, account_id, period_end, balance_minor, due_date FROM statements QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY period_end DESC, statement_id) = 1")
def latest_statements(spark, sf):
    return books.latest_statement(view.statements(spark, sf)).select("statement_id", "account_id", "period_end", "balance_minor", "due_date")


_VIEW = f"""WITH {STATEMENTS}, latest AS (SELECT * FROM statements WHERE period_end <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY period_end DESC) = 1),
  viewed AS (SELECT a.*, s.balance_minor AS statement_minor, s.minimum_due_minor, s.due_date, s.period_end, coalesce(s.balance_minor, 0) AS current_minor, coalesce(s.period_end, DATE '{AS_OF}') AS as_of
  FROM accounts a LEFT JOIN latest s ON a.account_id = s.account_id AND a.currency = s.currency)"""


def _account_view(spark, sf):
    return books.account_view(view.accounts(spark, sf), view.statements(spark, sf), AS_OF)


@query(_VIEW + " SELECT account_id, current_minor, statement_minor, minimum_due_minor, due_date, as_of FROM viewed")
def account_views(spark, sf):
    return _account_view(spark, sf).select("account_id", "current_minor", "statement_minor", "minimum_due_minor", "due_date", "as_of")


@query(f"WITH {LEDGER} SELECT txn_id, account_id, posted_at, amount_minor FROM ledger WHERE posted_at BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def ledger_slice(spark, sf):
    return books.ledger_slice(view.ledger(spark, sf), from_="1995-01-01", to="1995-12-31").select("txn_id", "account_id", "posted_at", "amount_minor")


@query(f"WITH {LEDGER} SELECT txn_id, account_id, posted_at, amount_minor FROM ledger ORDER BY posted_at DESC, txn_id LIMIT 20")
def recent_transactions(spark, sf):
    return books.recent_transactions(view.ledger(spark, sf)).select("txn_id", "account_id", "posted_at", "amount_minor")


@query(f"WITH {STATEMENTS} SELECT statement_id, due_date, balance_minor FROM statements WHERE due_date BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'")
def statements_due(spark, sf):
    return books.due_between(view.statements(spark, sf), "1996-03-01", "1996-05-31").select("statement_id", "due_date", "balance_minor")


@query(f"WITH {ACCOUNTS} SELECT account_id, kind, currency FROM accounts WHERE is_active AND owner_id = 'O7'")
def active_accounts(spark, sf):
    return books.active_accounts(view.accounts(spark, sf), "O7").select("account_id", "kind", "currency")


_NORMAL = """normal AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(
    CASE WHEN region = 'IN' AND contains(stripped, '/') THEN coalesce(list_filter(string_split(stripped, '/'), lambda x: trim(x) <> '' AND NOT regexp_full_match(trim(x), '\\d+'))[1], stripped) ELSE stripped END,
    '([a-z])([A-Z])', '\\1 \\2', 'g')), '[*#]\\s*\\w*\\d\\w*\\s*$', ' ', 'g'), '\\b\\d{3,}\\b', ' ', 'g'), '\\b(?:llc|inc|ltd|pvt|private|limited|corp|co)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS plain
  FROM (SELECT *, CASE region WHEN 'US' THEN regexp_replace(trim(descriptor_raw), '(?i)^(?:SQ \\*|SQ\\*)', '') ELSE regexp_replace(trim(descriptor_raw), '(?i)^(?:UPI/|UPI-)', '') END AS stripped FROM ledger)),
  keyed AS (SELECT *, CASE plain WHEN 'amzn mktp us' THEN 'amazon marketplace' ELSE array_to_string(list_transform(string_split(plain, ' '), lambda w: CASE w WHEN 'wholefds' THEN 'whole foods' WHEN 'amzn' THEN 'amazon' ELSE w END), ' ') END AS merchant_key FROM normal)"""


def _keyed(spark, sf):
    return view.ledger(spark, sf).withColumn("merchant_key", text.merchant_key(F.col("descriptor_raw"), F.col("region")))


@query(f"WITH {LEDGER}, {_NORMAL} SELECT region, merchant_key, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM keyed GROUP BY ALL")
def merchants(spark, sf):
    return _keyed(spark, sf).groupBy("region", "merchant_key").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("amount_minor"))


@query(f"WITH {LEDGER} SELECT txn_id, sha256('5:alert|' || length(source_ref) || ':' || source_ref || '|1:0') AS dedupe_key FROM ledger")
def dedupe_keys(spark, sf):
    return view.ledger(spark, sf).select("txn_id", dedupe_key(F.col("source"), F.col("source_ref"), F.col("ordinal")).alias("dedupe_key"))


def _prefixed(*parts: str) -> str:
    return " || '|' || ".join(f"length(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR)" for p in parts)


@query(f"""WITH {LEDGER}, {_NORMAL}, stated AS (SELECT account_id, posted_at, amount_minor, currency, merchant_key, source, source_ref FROM keyed UNION ALL
    SELECT account_id, CAST(posted_at + CAST(k % 6 AS INTEGER) AS DATE), CASE WHEN k % 11 = 0 THEN amount_minor + amount_minor // 10 ELSE amount_minor END, currency, merchant_key, 'statement_pdf', 'L' || txn_id FROM keyed WHERE k % 13 <> 0),
  printed AS (SELECT sha256({_prefixed("account_id", "posted_at", "amount_minor", "currency", "merchant_key")}) AS fingerprint, source, source_ref FROM stated)
  SELECT fingerprint, source, source_ref FROM printed WHERE fingerprint IN (SELECT fingerprint FROM printed GROUP BY 1 HAVING count(DISTINCT source || source_ref) > 1)""")
def suspected_duplicates(spark, sf):
    """Ledger and statement lines that state the same content under different provenances."""
    a = _keyed(spark, sf).select("account_id", "posted_at", "amount_minor", "currency", "merchant_key", "source", "source_ref")
    b = view.statement_lines(spark, sf).withColumn("merchant_key", text.merchant_key(F.col("descriptor_raw"), F.col("region"))).select("account_id", "posted_at", "amount_minor", "currency", "merchant_key", F.lit("statement_pdf").alias("source"), F.col("line_id").alias("source_ref"))
    rows = a.unionByName(b).withColumn("fingerprint", content_fingerprint(*(F.col(c) for c in ("account_id", "posted_at", "amount_minor", "currency", "merchant_key"))))
    return books.suspected_duplicates(rows).select("fingerprint", "source", "source_ref")


@query("""SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS minor, printf('%.2f', CAST(o_totalprice AS DECIMAL(18, 2))) AS shown FROM orders""")
def parsed_amounts(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey", "concat('$', format_number(CAST(o_totalprice AS DECIMAL(18, 2)), 2)) AS t").withColumn("m", money.parse_amount(F.col("t"), F.lit("USD")))
    return rows.select("o_orderkey", F.col("m.minor").alias("minor"), money.to_decimal_string(F.col("m.minor"), F.lit("USD")).alias("shown"))


@query("""SELECT o_orderkey, CAST(date_part('day', last_day(d)) AS INTEGER) AS days, CAST(dayofweek(d) AS INTEGER) AS weekday, strftime(d, '%Y-%m') AS month,
  CAST(last_day(d) - CAST(CASE dayofweek(last_day(d)) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS DATE) AS business_day, CAST(d + to_months(5) AS DATE) AS later FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def calendar_columns(spark, sf):
    d = F.col("d")
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS d")
    return rows.select("o_orderkey", cal.days_in_month(d).alias("days"), cal.weekday(d).alias("weekday"), cal.month_key(d).alias("month"), cal.last_business_day(d).alias("business_day"), cal.add_months_clamped(d, F.lit(5)).alias("later"))


@query("""WITH r AS (SELECT c_custkey AS id, DATE '2024-01-31' - CAST(c_custkey % 28 AS INTEGER) AS anchor, c_custkey % 3 AS k, CAST(1 + c_custkey % 4 AS INTEGER) AS i FROM customer), s AS (
  SELECT id, CASE k WHEN 0 THEN CAST(anchor + to_months(CAST(x * i AS INTEGER)) AS DATE) WHEN 1 THEN CAST(anchor + CAST(x * 7 * i AS INTEGER) AS DATE)
    ELSE CAST(last_day(anchor + to_months(CAST(x * i AS INTEGER))) - CAST(CASE dayofweek(last_day(anchor + to_months(CAST(x * i AS INTEGER)))) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS DATE) END AS occurs_on, anchor
  FROM r, range(0, 60) t(x)) SELECT DISTINCT id, occurs_on FROM s WHERE occurs_on BETWEEN DATE '2024-03-01' AND DATE '2024-12-31' AND occurs_on >= anchor""")
def occurrences(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey AS id", "CASE c_custkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'weekly' ELSE 'last_business_day' END AS kind", "CAST(1 + c_custkey % 4 AS INT) AS interval", "CAST(NULL AS STRING) AS second_day",
        "date_sub(DATE'2024-01-31', CAST(c_custkey % 28 AS INT)) AS anchor",
    )
    return cal.expand_occurrences(rows, F.lit("2024-03-01").cast("date"), F.lit("2024-12-31").cast("date")).select("id", "occurs_on")


def _debts(spark, sf):
    rows = books.debt_accounts(_account_view(spark, sf))
    return rows.selectExpr("account_id", "owner_id", "currency", "statement_minor AS owed_minor", "minimum_due_minor", "due_date AS due_on", "period_end AS observed_on", "apr_bp", "'high' AS confidence", "statement_minor", "current_minor")


_DEBT = _VIEW + f""", debts AS (SELECT *, due_date AS due_on, period_end AS observed_on FROM viewed WHERE kind NOT IN ('checking', 'savings')), positions AS (SELECT *, date_diff('day', due_on, DATE '{AS_OF}') AS late,
  observed_on IS NULL OR date_diff('day', observed_on, DATE '{AS_OF}') > 35 AS old FROM debts)"""


@query(_DEBT + " SELECT account_id, CAST(-late AS INTEGER) AS days_until_due, coalesce(late > 0, false) AS overdue, old AS stale, CASE WHEN statement_minor IS NULL THEN 'low' WHEN old THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN late > 0 THEN 'overdue' WHEN apr_bp > 2000 THEN 'high' WHEN apr_bp > 1500 THEN 'elevated' ELSE 'normal' END AS band FROM positions")
def debt_positions(spark, sf):
    rows = debt.debt_map(_debts(spark, sf), AS_OF).positions
    return rows.select("account_id", "days_until_due", "overdue", "stale", "confidence", debt.apr_band(F.col("apr_bp"), F.col("overdue")).alias("band"))


@query(_DEBT + """ SELECT owner_id, currency, CAST(coalesce(sum(statement_minor), 0) AS BIGINT) AS owed_minor, CAST(coalesce(sum(minimum_due_minor), 0) AS BIGINT) AS minimum_due_minor, count(statement_minor) AS observed, count(*) AS total,
  count(statement_minor) / count(*) AS coverage, count(*) FILTER (statement_minor IS NULL) AS missing, count(*) FILTER (old AND statement_minor IS NOT NULL) AS stale,
  CASE min(CASE WHEN statement_minor IS NULL THEN 0 WHEN old THEN 1 ELSE 2 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM positions GROUP BY ALL""")
def debt_totals(spark, sf):
    return debt.debt_map(_debts(spark, sf), AS_OF).totals


@query(_DEBT + " SELECT owner_id, currency, account_id, statement_minor IS NULL AS missing, old AND statement_minor IS NOT NULL AS stale FROM positions")
def debt_evidence(spark, sf):
    return debt.debt_evidence(debt.debt_map(_debts(spark, sf), AS_OF).positions)


@query(_DEBT + f" SELECT due_on, currency, CAST(sum(coalesce(statement_minor, current_minor)) AS BIGINT) AS amount_minor, CAST(coalesce(sum(minimum_due_minor), 0) AS BIGINT) AS minimum_due_minor, count(*) AS entries FROM debts WHERE due_on BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30 GROUP BY ALL")
def due_calendar(spark, sf):
    return debt.due_calendar(_debts(spark, sf), AS_OF, horizon_days=30).day_totals


_WORTH = f"WITH {ACCOUNTS}, worth AS (SELECT owner_id, currency, CAST(sum(CASE WHEN kind IN ('checking', 'savings') THEN balance_minor ELSE 0 END) AS BIGINT) AS assets_minor, CAST(sum(CASE WHEN kind IN ('checking', 'savings') THEN 0 ELSE abs(balance_minor) END) AS BIGINT) AS debts_minor FROM accounts GROUP BY ALL)"


@query(_WORTH + " SELECT *, assets_minor - debts_minor AS net_minor FROM worth")
def net_worth(spark, sf):
    return networth.net_worth(view.accounts(spark, sf))


@query(_WORTH + ", v AS (SELECT owner_id, currency, greatest(assets_minor - debts_minor, 0) * CASE currency WHEN 'USD' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 86 END AS value FROM worth) SELECT owner_id, currency, CASE WHEN sum(value) OVER (PARTITION BY owner_id) = 0 THEN 50.0 ELSE value * 100 / sum(value) OVER (PARTITION BY owner_id) END AS share FROM v")
def currency_exposure(spark, sf):
    weights = view.accounts(spark, sf).select("currency").distinct().withColumn("weight", F.when(F.col("currency") == "USD", 1.0).otherwise(F.lit(1.0) / 86))
    return networth.currency_exposure(networth.net_worth(view.accounts(spark, sf)), weights)


@query(_VIEW + f" SELECT owner_id, count(*) FILTER (abs(date_diff('day', period_end, DATE '{AS_OF}')) > 10) AS stale, count(*) FILTER (abs(date_diff('day', period_end, DATE '{AS_OF}')) <= 10) AS observed, count(*) AS total, count(*) FILTER (abs(date_diff('day', period_end, DATE '{AS_OF}')) <= 10) / count(*) AS ratio, max(period_end) AS latest FROM viewed GROUP BY ALL")
def coverage(spark, sf):
    out = networth.coverage(_account_view(spark, sf).withColumn("observed_on", F.col("period_end")), AS_OF)
    return out.withColumn("total", F.col("total").cast("bigint"))


@query(_VIEW + f", s AS (SELECT owner_id, currency, CAST(coalesce(sum(CASE WHEN due_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 21 THEN statement_minor END), 0) AS BIGINT) AS due_minor, CAST(sum(CASE WHEN kind IN ('checking', 'savings') THEN balance_minor ELSE 0 END) AS BIGINT) AS liquid_minor FROM viewed GROUP BY ALL) SELECT *, liquid_minor - due_minor AS headroom_minor FROM s")
def headroom(spark, sf):
    return networth.headroom(_account_view(spark, sf), AS_OF)


@query(f"WITH {LEDGER} SELECT account_id, source, min(posted_at) AS since, max(posted_at) AS until, count(*) AS rows FROM ledger GROUP BY ALL")
def account_coverage(spark, sf):
    return networth.account_coverage(view.ledger(spark, sf))


def _flow(spark, sf):
    """Every account with events is projected over January 2024: purchases and errors are dues, sign-ups pay in."""
    flows = view.event_flows(spark, sf)
    sums = flows.where("day BETWEEN '2024-01-01' AND '2024-01-30'").groupBy("account_id", "day", "direction").agg(F.sum("amount_minor").alias("amount_minor"))
    requests = sums.select("account_id").distinct().selectExpr("account_id", "DATE'2024-01-01' AS today", "29 AS horizon_days", "CAST(20000 AS BIGINT) AS opening_minor", "CAST(5000 AS BIGINT) AS floor_minor", "'USD' AS currency", "90 AS max_deferral_days")
    owed = sums.where("direction = 'outflow'").selectExpr("account_id", "concat('o', date_format(day, 'dd')) AS id", "day AS due_on", "amount_minor", "'USD' AS currency", "dayofmonth(day) % 2 = 0 AS movable", "CAST(NULL AS DATE) AS latest_move_to", "amount_minor DIV 10 AS minimum_due_minor", "'high' AS confidence")
    paid = sums.where("direction = 'inflow'").selectExpr("account_id", "concat('i', date_format(day, 'dd')) AS id", "day AS expected_on", "amount_minor", "'USD' AS currency", "'high' AS confidence")
    return cashflow.project_cash_flow(requests, owed, paid)


_FLOW = """WITH flows AS (SELECT 'E' || user_id AS account_id, CAST(ts AS DATE) AS day, event_type = 'signup' AS inflow, CAST(round(abs(value) * 100) AS BIGINT) AS amount_minor FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
  net AS (SELECT account_id, day, CAST(sum(CASE WHEN inflow THEN 0 ELSE amount_minor END) AS BIGINT) AS outflow_minor, CAST(sum(CASE WHEN inflow THEN amount_minor ELSE 0 END) AS BIGINT) AS inflow_minor FROM flows WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY ALL),
  spine AS (SELECT account_id, CAST(DATE '2024-01-01' + CAST(x AS INTEGER) AS DATE) AS day FROM (SELECT DISTINCT account_id FROM net), range(0, 30) t(x)),
  closed AS (SELECT account_id, day, coalesce(outflow_minor, 0) AS outflow_minor, coalesce(inflow_minor, 0) AS inflow_minor, CAST(20000 + sum(coalesce(inflow_minor, 0) - coalesce(outflow_minor, 0)) OVER (PARTITION BY account_id ORDER BY day) AS BIGINT) AS closing_minor FROM spine LEFT JOIN net USING (account_id, day)),
  days AS (SELECT *, closing_minor - inflow_minor AS low_minor, closing_minor - inflow_minor < 5000 AS below FROM closed),
  islands AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY account_id ORDER BY day) AS INTEGER) AS island FROM days WHERE below),
  hits AS (SELECT account_id, min(day) AS from_day, max(day) AS to_day, arg_min(day, (low_minor, day)) AS worst_day, min(low_minor) AS worst_minor, 5000 - min(low_minor) AS shortfall_minor FROM islands GROUP BY account_id, island)"""


@query(_FLOW + " SELECT account_id, day, outflow_minor, inflow_minor, closing_minor, low_minor, below FROM days")
def cash_flow_days(spark, sf):
    return _flow(spark, sf).days.select("account_id", "day", "outflow_minor", "inflow_minor", "closing_minor", "low_minor", "below")


@query(_FLOW + " SELECT * FROM hits")
def cash_flow_collisions(spark, sf):
    return _flow(spark, sf).collisions


@query(_FLOW + """, runs AS (SELECT account_id, day, outflow_minor, min(day) OVER (PARTITION BY account_id, island) AS from_day FROM islands)
  SELECT account_id, from_day, day, 'o' || strftime(day, '%d') AS id, true AS obligation, outflow_minor, CAST(row_number() OVER (PARTITION BY account_id, from_day ORDER BY day) AS INTEGER) AS ordinal FROM runs WHERE outflow_minor > 0""")
def cash_flow_collision_events(spark, sf):
    return _flow(spark, sf).collision_events


@query(_FLOW + """, pairs AS (SELECT h.*, 'o' || strftime(n.day, '%d') AS id, n.day AS due_on, n.outflow_minor AS amount, n.outflow_minor // 10 AS least, date_part('day', n.day) % 2 = 0 AS movable FROM hits h JOIN net n ON n.account_id = h.account_id AND n.day <= h.from_day AND n.outflow_minor > 0),
  found AS (SELECT *, 'move_payment' AS remedy, CAST(to_day + 1 AS DATE) AS to_date, amount AS deferred_minor, CAST(to_day + 1 - due_on AS INTEGER) AS displacement FROM pairs WHERE movable AND amount >= shortfall_minor AND to_day + 1 <= DATE '2024-01-30'
    UNION ALL SELECT *, 'pay_minimum', NULL, amount - least, 0 FROM pairs WHERE least < amount AND amount - least >= shortfall_minor),
  judged AS (SELECT f.account_id, f.from_day, f.to_day, f.id, remedy, to_date, displacement, deferred_minor, min(d.low_minor + CASE WHEN d.day >= f.due_on AND (to_date IS NULL OR d.day < to_date) THEN deferred_minor ELSE 0 END) AS low FROM found f JOIN days d ON d.account_id = f.account_id GROUP BY ALL)
  SELECT account_id, from_day, to_day, id, remedy, to_date, displacement, deferred_minor, least(20000, low) AS resulting_worst_minor, low >= 5000 AS clears_all,
    CAST(row_number() OVER (PARTITION BY account_id, from_day ORDER BY low >= 5000 DESC, CASE remedy WHEN 'move_payment' THEN 0 ELSE 1 END, displacement, id, to_date) AS INTEGER) AS rank FROM judged""")
def cash_flow_remedies(spark, sf):
    return _flow(spark, sf).remedies


@query(_FLOW + """ SELECT account_id, 'USD' AS currency, CAST(20000 AS BIGINT) AS opening_minor, arg_max(closing_minor, day) AS closing_minor, CAST(sum(inflow_minor) AS BIGINT) AS inflow_minor, CAST(sum(outflow_minor) AS BIGINT) AS outflow_minor, count(*) FILTER (below) AS days_below,
  least(20000, min(low_minor)) AS lowest_minor, CASE WHEN min(low_minor) < 20000 THEN arg_min(day, (low_minor, day)) ELSE min(day) END AS lowest_on, arg_min(day, (closing_minor, day)) AS trough_on, CASE WHEN sum(inflow_minor) = 0 THEN 'low' ELSE 'high' END AS confidence FROM days GROUP BY account_id""")
def cash_flow_summary(spark, sf):
    return _flow(spark, sf).summary


@query(_FLOW + ", s AS (SELECT account_id, day, closing_minor, unnest([-10000, 10000]) AS delta FROM days) SELECT CASE WHEN delta < 0 THEN 'less' ELSE 'more' END AS scenario, account_id, min(closing_minor + delta) AS trough_minor, arg_min(day, (closing_minor, day)) AS trough_on FROM s GROUP BY account_id, delta")
def what_if(spark, sf):
    days = _flow(spark, sf).days
    ids = days.select("account_id").distinct()
    return cashflow.what_if(days, ids.selectExpr("account_id", "'less' AS scenario", "CAST(-10000 AS BIGINT) AS delta_minor").unionByName(ids.selectExpr("account_id", "'more' AS scenario", "CAST(10000 AS BIGINT) AS delta_minor")))


_AUTH = "CASE o_orderkey % 10 WHEN 7 THEN 'dmarc_failed' WHEN 8 THEN 'untrusted_authserv' WHEN 9 THEN 'no_auth_header' END"


@query(f"""WITH m AS (SELECT o_orderkey AS uid, {_AUTH} AS auth, o_orderkey % 6 AS k FROM orders) SELECT uid, CASE WHEN auth IS NOT NULL OR k = 5 THEN 'quarantined' WHEN k = 4 THEN 'ignored' ELSE 'parsed' END AS status,
  CASE WHEN auth IS NOT NULL THEN 'failed_authenticity' WHEN k = 5 THEN 'no_parser_matched' END AS reason, CASE WHEN auth IS NOT NULL THEN auth WHEN k = 4 THEN 'localpart_not_allowlisted' END AS detail,
  CASE WHEN auth IS NULL THEN CASE k WHEN 0 THEN 'us-bank-alert' WHEN 1 THEN 'chase-statement' WHEN 2 THEN 'sbi-card-alert' WHEN 3 THEN 'zolve-statement' END END AS parser_id FROM m""")
def message_outcomes(spark, sf):
    return ingest.route_messages(view.messages(spark, sf), ingest.sender_rules(spark)).outcomes.select("uid", "status", "reason", "detail", "parser_id")


@query(f"""WITH m AS (SELECT o_orderkey AS uid, o_orderkey % 6 AS k, o_custkey, CAST(o_orderdate AS DATE) AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS minor FROM orders WHERE {_AUTH} IS NULL AND o_orderkey % 6 < 4) SELECT uid, CASE WHEN k IN (0, 2) THEN 'transaction' ELSE 'statement' END AS kind,
  minor AS amount_minor, CASE WHEN k = 2 THEN 'INR' ELSE 'USD' END AS currency, CASE WHEN k IN (0, 2) THEN lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') END AS last4, CASE k WHEN 1 THEN 2500 WHEN 3 THEN 1000 END AS minimum_minor,
  CASE k WHEN 0 THEN d WHEN 2 THEN CASE WHEN date_part('year', d) < 2000 THEN CAST(d + to_years(100) AS DATE) ELSE d END END AS posted_at, CASE WHEN k = 1 THEN d END AS due_date, CASE WHEN k = 3 THEN d - 30 END AS period_start, CASE WHEN k = 3 THEN d END AS period_end, CASE WHEN k = 2 THEN 'SWIGGY' END AS descriptor_raw FROM m""")
def message_facts(spark, sf):
    facts = ingest.route_messages(view.messages(spark, sf), ingest.sender_rules(spark)).facts
    return facts.select("uid", "kind", "amount_minor", "currency", "last4", "minimum_minor", "posted_at", "due_date", "period_start", "period_end", "descriptor_raw")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?is)<head\\b[^>]*>.*?</head\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS body FROM pages")
def stripped_pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.trim(F.regexp_replace(text.strip_html(F.col("html")), r"[ \t\n\r\f\x0B]+", " ")).alias("body"))


def _greedy_sql(ratio: float) -> str:
    """Rounds of pairs that come first on both sides; what a round takes closes its alert and line for the others."""
    return f"""WITH RECURSIVE {LEDGER}, named AS (SELECT *, CASE WHEN descriptor_raw LIKE 'SQ *COFFEE BAR %' AND k % 9000 >= 100 THEN 'coffee bar' ELSE descriptor_raw END AS merchant FROM ledger),
  lines AS (SELECT 'L' || txn_id AS line, account_id, currency, CAST(posted_at + CAST(k % 6 AS INTEGER) AS DATE) AS b_day, CASE WHEN k % 11 = 0 THEN amount_minor + amount_minor // 10 ELSE amount_minor END AS b_minor, merchant AS b_merchant FROM named WHERE k % 13 <> 0),
  pairs AS (SELECT n.account_id, n.currency, txn_id AS alert, line, abs(amount_minor - b_minor) * 1000 + abs(date_diff('day', posted_at, b_day)) * 10 + CASE WHEN merchant = b_merchant THEN 0 ELSE 1 END AS score, posted_at, b_day
    FROM named n JOIN lines USING (account_id, currency) WHERE abs(date_diff('day', posted_at, b_day)) <= 4 AND abs(amount_minor - b_minor) <= abs(amount_minor) * {ratio}),
  ranked AS (SELECT account_id, currency, alert, line, CAST(score AS BIGINT) AS score, row_number() OVER (ORDER BY score, posted_at, alert, b_day, line) AS o FROM pairs),
  rounds(account_id, currency, alert, line, score, o, taken) AS (
    SELECT *, false FROM ranked
    UNION ALL
    SELECT account_id, currency, alert, line, score, o, taken FROM (SELECT *, bool_or(taken) OVER (PARTITION BY alert) AS gone_a, bool_or(taken) OVER (PARTITION BY line) AS gone_b FROM (
      SELECT account_id, currency, alert, line, score, o, o = min(o) OVER (PARTITION BY alert) AND o = min(o) OVER (PARTITION BY line) AS taken FROM rounds WHERE NOT taken)) WHERE taken OR NOT (gone_a OR gone_b)
  )
  SELECT account_id, currency, alert, line, score FROM rounds WHERE taken"""


@query(_greedy_sql(0))
def reconciled(spark, sf):
    """Matches of alerts with statement lines, exact amounts within four days."""
    return reconcile.reconcile(view.ledger(spark, sf), view.statement_lines(spark, sf)).matched


@query(_greedy_sql(0.12))
def reconciled_with_drift(spark, sf):
    return reconcile.reconcile(view.ledger(spark, sf), view.statement_lines(spark, sf), amount_drift_ratio=0.12).matched


@query()
def recurring_streams(spark, sf):
    return recurring.detect_recurring(view.recurring_seed(spark, sf), "2024-02-15").streams.drop("floor_minor")


@query()
def price_step_events(spark, sf):
    rows = view.recurring_seed(spark, sf)
    found = recurring.detect_recurring(rows, "2024-02-15")
    return price_steps.detect_price_steps(found.occurrences, found.streams).steps


def _cited(spark, sf):
    """An insight for each month and owner with more out than in, citing its transactions."""
    rows = view.ledger(spark, sf).withColumn("month", F.date_format("posted_at", "yyyy-MM"))
    key = F.concat_ws(":", "owner_id", "currency", "month")
    evidence = rows.select(key.alias("insight_id"), F.lit("transaction").alias("kind"), F.col("txn_id").alias("evidence_id"), F.dayofmonth("posted_at").alias("ordinal"))
    made = reports.monthly_totals(rows).where("outflow_minor > inflow_minor").select(key.alias("insight_id"), F.lit("overspent").alias("insight_kind"), "outflow_minor")
    return made, evidence


@query(f"WITH {LEDGER}, m AS (SELECT owner_id || ':' || currency || ':' || strftime(posted_at, '%Y-%m') AS insight_id, * FROM ledger) SELECT insight_id, 'overspent' AS insight_kind, CAST(sum(greatest(-amount_minor, 0)) AS BIGINT) AS outflow_minor, string_agg('transaction:' || txn_id, ',' ORDER BY date_part('day', posted_at), txn_id) AS evidence FROM m GROUP BY insight_id HAVING sum(amount_minor) < 0")
def insights_with_evidence(spark, sf):
    return insights.with_evidence(*_cited(spark, sf)).withColumn("evidence", F.array_join("evidence", ","))


@query(f"WITH {LEDGER}, m AS (SELECT owner_id || ':' || currency || ':' || strftime(posted_at, '%Y-%m') AS insight_id, * FROM ledger) SELECT insight_id FROM m GROUP BY insight_id HAVING sum(amount_minor) < 0 AND count(*) FILTER (abs(amount_minor) > 30000000) > 0")
def insights_citing(spark, sf):
    made, evidence = _cited(spark, sf)
    large = view.ledger(spark, sf).where("abs(amount_minor) > 30000000").select(F.lit("transaction").alias("kind"), F.col("txn_id").alias("evidence_id"))
    return insights.citing(made, evidence, large).select("insight_id")


@query(f"WITH {STATEMENTS} SELECT statement_id FROM statements WHERE NOT (period_start <= period_end AND (due_date IS NULL OR due_date >= period_start) AND (minimum_due_minor IS NULL OR minimum_due_minor BETWEEN 0 AND balance_minor))")
def statement_violations(spark, sf):
    return quality.check_rows(view.statements(spark, sf), quality.statement_rules()).select("statement_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_lines(spark, sf):
    return quality.check_unique(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {ACCOUNTS} SELECT 'R' || c_custkey AS id, 'A' || (c_custkey * 3) AS account_id FROM customer WHERE 'A' || (c_custkey * 3) NOT IN (SELECT account_id FROM accounts)")
def dangling_accounts(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("concat('R', c_custkey) AS id", "concat('A', c_custkey * 3) AS account_id")
    return quality.check_refs(rows, view.accounts(spark, sf), "account_id").select("id", "account_id")


@query(f"WITH {LEDGER}, fees AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'interest' WHEN k % 23 = 0 THEN 'late_fee' END AS fee_type FROM ledger) SELECT owner_id, currency, fee_type, txn_id, posted_at, abs(amount_minor) AS fee_minor FROM fees WHERE fee_type IS NOT NULL AND posted_at > CAST(DATE '{AS_OF}' - to_months(12) AS DATE) AND posted_at <= DATE '{AS_OF}'")
def fee_evidence(spark, sf):
    return reports.fee_evidence(view.ledger(spark, sf).withColumn("fee_type", F.expr("CASE WHEN k % 17 = 0 THEN 'interest' WHEN k % 23 = 0 THEN 'late_fee' END")), AS_OF)


@query(f"WITH {LEDGER}, fees AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'interest' WHEN k % 23 = 0 THEN 'late_fee' END AS fee_type FROM ledger) SELECT owner_id, currency, fee_type, CAST(sum(abs(amount_minor)) AS BIGINT) AS fee_minor, count(*) AS n, min(txn_id) AS first_txn, max(txn_id) AS last_txn FROM fees WHERE fee_type IS NOT NULL AND posted_at > CAST(DATE '{AS_OF}' - to_months(12) AS DATE) AND posted_at <= DATE '{AS_OF}' GROUP BY ALL")
def fee_ledger(spark, sf):
    return reports.fee_ledger(view.ledger(spark, sf).withColumn("fee_type", F.expr("CASE WHEN k % 17 = 0 THEN 'interest' WHEN k % 23 = 0 THEN 'late_fee' END")), AS_OF)


@query(f"""WITH {LEDGER}, s AS (SELECT owner_id, descriptor_raw, currency, strftime(posted_at, '%Y-%m') AS month, sum(amount_minor) AS total, count(*) AS n FROM (SELECT * REPLACE (split_part(descriptor_raw, ' ', 1) AS descriptor_raw) FROM ledger) GROUP BY ALL),
  p AS (SELECT owner_id, descriptor_raw, currency, strftime(CAST(month || '-01' AS DATE) + to_months(1), '%Y-%m') AS month, total AS was, n AS n_was FROM s), b AS (SELECT * FROM s FULL JOIN p USING (owner_id, descriptor_raw, currency, month))
  SELECT owner_id, descriptor_raw, currency, month, CAST(coalesce(total, 0) - coalesce(was, 0) AS BIGINT) AS delta_minor, CAST(CASE WHEN total IS NOT NULL AND was IS NOT NULL THEN round(CAST((n - n_was) * was AS DOUBLE) / n_was) ELSE 0 END AS BIGINT) AS volume_minor,
    CAST(CASE WHEN total IS NOT NULL AND was IS NOT NULL THEN total - was - round(CAST((n - n_was) * was AS DOUBLE) / n_was) ELSE 0 END AS BIGINT) AS price_minor, CAST(CASE WHEN was IS NULL THEN total ELSE 0 END AS BIGINT) AS new_minor, CAST(CASE WHEN total IS NULL THEN -was ELSE 0 END AS BIGINT) AS lapsed_minor FROM b""")
def attribution(spark, sf):
    rows = view.ledger(spark, sf).withColumn("descriptor_raw", F.substring_index("descriptor_raw", " ", 1)).withColumn("month", F.date_format("posted_at", "yyyy-MM"))
    return reports.attribution(rows, ["owner_id", "descriptor_raw"])


@query(f"""WITH {LOTS}, {VALUATIONS}, held AS (SELECT account_id, instrument_id, currency, CAST(sum(units_micro) AS BIGINT) AS units_micro, CAST(sum(cost_minor) AS BIGINT) AS cost_minor FROM lots WHERE acquired_at <= DATE '1996-06-30' GROUP BY ALL),
  priced AS (SELECT instrument_id, arg_max(price_minor_e4, as_of_date) AS price, max(as_of_date) AS priced_on FROM valuations WHERE as_of_date <= DATE '1996-06-30' GROUP BY ALL),
  v AS (SELECT h.*, priced_on, price IS NULL AS unpriced, coalesce(CAST((CAST(units_micro AS HUGEINT) * price + 5000000000) // 10000000000 AS BIGINT), cost_minor) AS value_minor FROM held h LEFT JOIN priced USING (instrument_id))
  SELECT account_id, instrument_id, currency, units_micro, cost_minor, value_minor, priced_on, unpriced, value_minor - cost_minor AS gain_minor FROM v""")
def portfolio(spark, sf):
    return holdings.holdings(view.lots(spark, sf), view.valuations(spark, sf), "1996-06-30").drop("simple_return")


@query()
def money_weighted_returns(spark, sf):
    """Yearly return of each account's lots, bought at cost and worth their value at the end."""
    lots = view.lots(spark, sf).where("acquired_at < '1996-06-30'")
    paid = lots.select("account_id", F.col("acquired_at").alias("on"), (-F.col("cost_minor")).alias("amount_minor"))
    worth = holdings.holdings(lots, view.valuations(spark, sf), "1996-06-30").groupBy("account_id").agg(F.sum("value_minor").alias("amount_minor"))
    return holdings.xirr(paid.unionByName(worth.select("account_id", F.lit("1996-06-30").cast("date").alias("on"), "amount_minor")), ["account_id"])


@query(f"""WITH {LEDGER}, days AS (SELECT CAST(min(posted_at) - 7 AS DATE) AS a, max(posted_at) AS b FROM (SELECT CAST(o_orderdate AS DATE) AS posted_at FROM orders)),
  rates AS (SELECT CAST(d AS DATE) AS rate_date, 800000 + date_diff('day', DATE '1990-01-01', CAST(d AS DATE)) % 97 * 1000 AS rate FROM days, generate_series(a, b, INTERVAL 1 DAY) t(d) WHERE dayofweek(d) = 1)
  SELECT txn_id, rate_date, CAST(sign(amount_minor) * ((abs(CAST(amount_minor AS HUGEINT)) * 10000 * 2 + rate) // (2 * rate)) AS BIGINT) AS usd_minor FROM ledger ASOF JOIN rates ON ledger.posted_at >= rates.rate_date WHERE currency = 'INR'""")
def converted(spark, sf):
    rows = holdings.convert(view.ledger(spark, sf).where("currency = 'INR'"), view.fx_rates(spark, sf), "posted_at", "amount_minor")
    return rows.select("txn_id", "rate_date", "usd_minor")


@query(f"""WITH {STATEMENTS}, spine AS (SELECT CAST(DATE '1997-01-01' + CAST(x AS INTEGER) AS DATE) AS day FROM range(0, 60) t(x)), obs AS (SELECT s.*, a.owner_id FROM statements s JOIN accounts a USING (account_id)), pairs AS (SELECT DISTINCT owner_id, currency FROM obs WHERE period_end <= DATE '1997-03-01'),
  last AS (SELECT o.owner_id, o.account_id, o.currency, d.day, arg_max(balance_minor, period_end) AS balance FROM obs o JOIN spine d ON o.period_end <= d.day GROUP BY ALL)
  SELECT p.owner_id, p.currency, d.day, CAST(coalesce(sum(l.balance), 0) AS BIGINT) AS net_minor, count(l.account_id) AS accounts FROM pairs p CROSS JOIN spine d LEFT JOIN last l ON l.owner_id = p.owner_id AND l.currency = p.currency AND l.day = d.day GROUP BY ALL""")
def net_worth_series(spark, sf):
    s = view.statements(spark, sf).join(view.accounts(spark, sf).select("account_id", "owner_id"), "account_id")
    return networth.net_worth_series(s.select("owner_id", "account_id", "currency", F.col("period_end").alias("observed_on"), "balance_minor"), "1997-01-01", "1997-03-01")


@query(f"WITH {STATEMENTS} SELECT l.txn_id, s.statement_id FROM ledger l LEFT JOIN statements s ON s.account_id = l.account_id AND l.posted_at BETWEEN s.period_start AND s.period_end")
def covering_statements(spark, sf):
    return books.covering_statement(view.ledger(spark, sf), view.statements(spark, sf)).select("txn_id", "statement_id")


@query(f"""WITH {LEDGER}, p AS (SELECT txn_id, 'T' || lpad(CAST(k + 1 AS VARCHAR), 8, '0') AS kept_id FROM ledger WHERE k % 7 IN (0, 6))
  SELECT txn_id, kept_id, CASE WHEN kept_id NOT IN (SELECT txn_id FROM ledger) THEN 'unknown' WHEN kept_id IN (SELECT txn_id FROM p) THEN 'chained' ELSE 'marked' END AS outcome FROM p""")
def supersede_marks(spark, sf):
    rows = view.ledger(spark, sf).withColumn("superseded_by", F.lit(None).cast("string"))
    plan = rows.where("k % 7 IN (0, 6)").selectExpr("txn_id", "concat('T', lpad(CAST(k + 1 AS STRING), 8, '0')) AS by")
    made = books.apply_supersede(rows, plan)
    return books.superseded(made.ledger).select("txn_id", F.col("superseded_by").alias("kept_id"), F.lit("marked").alias("outcome")).unionByName(made.rejects.select("txn_id", F.col("by").alias("kept_id"), F.col("reason").alias("outcome")))


@query(f"WITH {LEDGER}, {_NORMAL} SELECT txn_id, CASE WHEN merchant_key LIKE 'w%' OR merchant_key LIKE 'a%' THEN 'alias-' ELSE 'key-' END || region || '-' || merchant_key AS merchant_id FROM keyed")
def alias_merchants(spark, sf):
    """Merchants have ids but for those in a; aliases lead elsewhere, and a user's own win."""
    rows = _keyed(spark, sf)
    keys = rows.select("region", "merchant_key").distinct()
    made = keys.where("merchant_key NOT LIKE 'a%'").selectExpr("region", "merchant_key", "concat('key-', region, '-', merchant_key) AS merchant_id")
    aliases = keys.selectExpr("region", "merchant_key AS alias", "concat('alias-', region, '-', merchant_key) AS merchant_id", "CASE WHEN merchant_key LIKE 'w%' THEN 'user' ELSE 'found' END AS origin")
    return books.with_alias_merchant(rows, made, aliases).select("txn_id", "merchant_id")


_FACTS = """SELECT o_orderkey AS uid, 'Bank' || (o_custkey % 40) AS institution, CASE WHEN o_custkey % 2 = 0 THEN 'USD' ELSE 'INR' END AS account_currency, 'O' || (o_custkey % 50) AS owner_id,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') END AS last4, CASE WHEN o_orderkey % 2 = 0 THEN 'credit_card' ELSE 'checking' END AS account_kind FROM orders"""


@query(f"""WITH {ACCOUNTS}, a AS (SELECT owner_id, 'Bank' || (CAST(substr(account_id, 2) AS BIGINT) % 30) AS institution, currency AS account_currency, account_id, kind AS a_kind, last4 AS a_last4, account_id AS display_name FROM accounts WHERE is_active), facts AS ({_FACTS}),
  fresh AS (SELECT owner_id, institution, account_currency, owner_id || ':' || institution || ':' || account_currency || ':' || coalesce(last4, substr(sha256('m' || uid), 1, 12)) AS account_id, account_kind AS a_kind, last4 AS a_last4, institution AS display_name
    FROM facts ANTI JOIN a USING (owner_id, institution, account_currency) QUALIFY row_number() OVER (PARTITION BY owner_id, institution, account_currency ORDER BY uid) = 1),
  known AS (SELECT * FROM a UNION ALL SELECT * FROM fresh)
  SELECT f.uid, k.account_id FROM facts f JOIN known k USING (owner_id, institution, account_currency) QUALIFY row_number() OVER (PARTITION BY f.uid ORDER BY CASE WHEN k.a_last4 = f.last4 THEN 0 WHEN k.a_kind = f.account_kind THEN 1 ELSE 2 END, k.display_name, k.account_id) = 1""")
def resolved_accounts(spark, sf):
    facts = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey AS uid", "concat('m', o_orderkey) AS message_id", "0 AS ordinal", "concat('Bank', o_custkey % 40) AS institution", "CASE WHEN o_custkey % 2 = 0 THEN 'USD' ELSE 'INR' END AS account_currency", "concat('O', o_custkey % 50) AS owner_id",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') END AS last4", "CASE WHEN o_orderkey % 2 = 0 THEN 'credit_card' ELSE 'checking' END AS account_kind",
    )
    accounts = view.accounts(spark, sf).withColumns({"institution": F.expr("concat('Bank', CAST(substr(account_id, 2) AS BIGINT) % 30)"), "display_name": F.col("account_id")})
    return ingest.resolve_accounts(facts, accounts)[0].select("uid", "account_id")


@query(f"""WITH {STATEMENTS}, lines AS (SELECT account_id || '-' || strftime(posted_at, '%Y-%m') AS statement_id, CAST(sum(amount_minor + CASE WHEN k % 97 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS lines_minor FROM ledger GROUP BY 1)
  SELECT statement_id, lines_minor - balance_minor AS difference_minor, CASE WHEN lines_minor <> balance_minor THEN 'total_mismatch' END AS reason FROM statements JOIN lines USING (statement_id)""")
def statement_totals(spark, sf):
    lines = view.ledger(spark, sf).selectExpr("concat(account_id, '-', date_format(posted_at, 'yyyy-MM')) AS statement_id", "amount_minor + CASE WHEN k % 97 = 0 THEN 1 ELSE 0 END AS amount_minor")
    good, bad = reports.statement_gate(view.statements(spark, sf), lines)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select("statement_id", "difference_minor", "reason")


@query(f"""WITH m AS (SELECT o_orderkey AS uid, {_AUTH} AS auth, o_orderkey % 6 AS k FROM orders) SELECT count(*) AS fetched, count(*) FILTER (auth IS NULL AND k < 4) AS parsed, count(*) FILTER (auth IS NULL AND k < 4) AS facts, count(*) FILTER (auth IS NULL AND k = 4) AS ignored, count(*) FILTER (auth IS NOT NULL OR k = 5) AS quarantined, max(uid) AS highest_uid FROM m""")
def sync_counts(spark, sf):
    return ingest.sync_counters(ingest.route_messages(view.messages(spark, sf), ingest.sender_rules(spark)).outcomes)


@query(f"""SELECT 'm' || o_orderkey AS message_id, CASE WHEN {_AUTH} IS NOT NULL THEN 'extract_threw' ELSE 'no_parser_matched' END AS reason FROM orders WHERE {_AUTH} IS NOT NULL OR o_orderkey % 6 = 5""")
def stored_failures(spark, sf):
    return ingest.parse_failures(ingest.route_messages(view.messages(spark, sf), ingest.sender_rules(spark)).outcomes).select("message_id", "reason")


@query("SELECT o_orderkey AS uid FROM orders WHERE o_orderkey % 5 = 4 OR o_orderkey % 3 < 2")
def messages_to_reparse(spark, sf):
    versions = spark.createDataFrame([(t.id, 2) for t in ingest.TEMPLATES], "parser_id string, version int")
    ids = F.array(*(F.lit(t.id) for t in ingest.TEMPLATES))
    stored = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("uid"), F.get(ids, (F.col("o_orderkey") % 5).cast("int")).alias("parser_id"), (F.col("o_orderkey") % 3).cast("int").alias("parser_version"))
    return ingest.needs_reparse(stored, versions).select("uid")


@query(f"""WITH {LEDGER}, worth AS (SELECT owner_id, currency, CAST(sum(CASE WHEN kind IN ('checking', 'savings') THEN balance_minor ELSE 0 END) AS BIGINT) AS assets_minor, CAST(sum(balance_minor) AS BIGINT) AS net_minor FROM accounts GROUP BY ALL),
  burn AS (SELECT owner_id, currency, CAST(sum(amount_minor) AS BIGINT) AS burn_minor FROM ledger WHERE amount_minor < 0 AND posted_at BETWEEN DATE '1998-01-01' AND DATE '1998-01-31' GROUP BY ALL)
  SELECT owner_id, currency, CAST(assets_minor AS DOUBLE) / greatest(abs(burn_minor), 100) AS months, CAST(abs(burn_minor) * 12 AS DOUBLE) * 25 AS target_minor, least(100.0, CAST(greatest(net_minor, 0) * 100 AS DOUBLE) / (CAST(abs(burn_minor) * 12 AS DOUBLE) * 25)) AS progress FROM worth JOIN burn USING (owner_id, currency)""")
def runways(spark, sf):
    worth = view.accounts(spark, sf).groupBy("owner_id", "currency").agg(F.sum(F.expr("CASE WHEN kind IN ('checking', 'savings') THEN balance_minor ELSE 0 END")).alias("assets_minor"), F.sum("balance_minor").alias("net_minor"))
    burn = view.ledger(spark, sf).where("amount_minor < 0 AND posted_at BETWEEN '1998-01-01' AND '1998-01-31'").groupBy("owner_id", "currency").agg(F.sum("amount_minor").alias("burn_minor"))
    return networth.runway(worth, burn)


@query(f"WITH {ACCOUNTS} SELECT owner_id, currency, CAST(sum(abs(balance_minor) // 100) AS BIGINT) AS monthly_minor, CAST(sum(abs(balance_minor) // 100) * 12 AS BIGINT) AS yearly_minor, count(*) AS bills FROM accounts GROUP BY ALL")
def bill_run_rates(spark, sf):
    return networth.run_rate(view.accounts(spark, sf).withColumn("monthly_minor", F.expr("abs(balance_minor) DIV 100")))


@query(f"""WITH {STATEMENTS}, seen AS (SELECT owner_id, max(period_end) AS observed_on FROM statements JOIN accounts USING (account_id) GROUP BY owner_id, account_id)
  SELECT owner_id, count(*) FILTER (abs(DATE '{AS_OF}' - observed_on) > 60) AS stale, count(*) FILTER (abs(DATE '{AS_OF}' - observed_on) <= 60) AS observed, count(*) AS total, CAST(count(*) FILTER (abs(DATE '{AS_OF}' - observed_on) <= 60) AS DOUBLE) / count(*) AS ratio, max(observed_on) AS latest FROM seen GROUP BY owner_id""")
def account_freshness(spark, sf):
    seen = view.statements(spark, sf).join(view.accounts(spark, sf).select("account_id", "owner_id"), "account_id").groupBy("owner_id", "account_id").agg(F.max("period_end").alias("observed_on"))
    return networth.coverage(seen, AS_OF, fresh_days=60)


@query(f"""WITH {LEDGER}, spent AS (SELECT owner_id, region AS category, currency, CAST(sum(-amount_minor) AS BIGINT) AS spent FROM ledger WHERE posted_at BETWEEN DATE '1996-03-01' AND DATE '1996-03-20' AND amount_minor < 0 GROUP BY ALL),
  due AS (SELECT owner_id, region AS category, currency, CAST(sum(-amount_minor) AS BIGINT) AS due FROM ledger WHERE posted_at BETWEEN DATE '1996-03-21' AND DATE '1996-03-31' AND amount_minor < 0 AND k % 4 = 0 GROUP BY ALL), b AS (SELECT DISTINCT owner_id, region AS category, currency FROM accounts)
  SELECT owner_id, category, currency, '1996-03' AS month, coalesce(spent, 0) AS spent_minor, 50500000 - coalesce(spent, 0) AS left_minor, coalesce(spent, 0) + CAST(round(CAST(coalesce(spent, 0) * 11 AS DOUBLE) / 20) AS BIGINT) + coalesce(due, 0) AS projected_minor FROM b LEFT JOIN spent USING (owner_id, category, currency) LEFT JOIN due USING (owner_id, category, currency)""")
def budgets(spark, sf):
    rows = view.ledger(spark, sf).withColumnRenamed("region", "category")
    made = view.accounts(spark, sf).selectExpr("owner_id", "region AS category", "currency", "'1996-03' AS month", "50000000L AS limit_minor", "500000L AS rollover_minor").distinct()
    bills = rows.where("k % 4 = 0 AND amount_minor < 0").selectExpr("owner_id", "category", "currency", "posted_at AS due_on", "-amount_minor AS amount_minor")
    return reports.budget_status(made, rows, bills, "1996-03-20")


@query(f"""WITH {LEDGER}, {_NORMAL}, m AS (SELECT owner_id, currency, merchant_key, strftime(posted_at, '%Y-%m') AS month, CAST(sum(-amount_minor) AS BIGINT) AS cost FROM keyed GROUP BY ALL), c AS (SELECT DISTINCT owner_id, currency, merchant_key, '1996-04' AS month FROM keyed),
  j AS (SELECT c.*, now_.cost AS now_cost, was.cost AS was_cost FROM c LEFT JOIN m now_ ON now_.owner_id = c.owner_id AND now_.currency = c.currency AND now_.merchant_key = c.merchant_key AND now_.month = '1996-04' LEFT JOIN m was ON was.owner_id = c.owner_id AND was.currency = c.currency AND was.merchant_key = c.merchant_key AND was.month = '1996-03')
  SELECT owner_id || '/' || currency || '/' || merchant_key AS commitment_id, coalesce(was_cost, 0) - coalesce(now_cost, 0) AS saved_minor, CASE WHEN was_cost IS NULL THEN 'unverifiable' WHEN coalesce(was_cost, 0) - coalesce(now_cost, 0) > 0 THEN 'realised' ELSE 'not_realised' END AS outcome FROM j""")
def commitments(spark, sf):
    rows = _keyed(spark, sf)
    monthly = rows.groupBy("owner_id", "currency", "merchant_key", F.date_format("posted_at", "yyyy-MM").alias("month")).agg(F.sum(-F.col("amount_minor")).alias("cost_minor"))
    made = rows.select("owner_id", "currency", "merchant_key").distinct().withColumns({"month": F.lit("1996-04"), "saving_type": F.lit("hard"), "commitment_id": F.concat_ws("/", "owner_id", "currency", "merchant_key")})
    return reports.verify_commitments(made, monthly).select("commitment_id", "saved_minor", "outcome")


@query(f"WITH {STATEMENTS} SELECT account_id, currency, balance_minor, period_end AS observed_on FROM statements QUALIFY row_number() OVER (PARTITION BY account_id, currency ORDER BY period_end DESC, balance_minor) = 1")
def latest_balances(spark, sf):
    return books.latest_balance(view.statements(spark, sf).select("account_id", "currency", "balance_minor", F.col("period_end").alias("observed_on")))


@query(f"WITH {STATEMENTS} SELECT statement_id, due_date FROM statements WHERE due_date >= DATE '1998-07-01'")
def upcoming_bills(spark, sf):
    return books.upcoming_bills(view.statements(spark, sf), "1998-07-01").select("statement_id", "due_date")


@query(f"WITH {ACCOUNTS} SELECT account_id, is_active FROM accounts")
def listed_accounts(spark, sf):
    return books.listed_accounts(view.accounts(spark, sf).withColumn("display_name", F.concat("kind", "last4"))).select("account_id", "is_active")


@query(f"WITH {STATEMENTS} SELECT statement_id, balance_minor FROM statements WHERE account_id = 'A7' AND strftime(period_start, '%Y-%m') = '1996-03'")
def statement_by_period(spark, sf):
    rows = view.statements(spark, sf).withColumn("period", F.date_format("period_start", "yyyy-MM"))
    return books.lookup(rows, account_id="A7", period="1996-03").select("statement_id", "balance_minor")


@query(f"WITH {LEDGER} SELECT txn_id FROM ledger WHERE k % 5 < 3")
def rows_to_recategorise(spark, sf):
    return books.needs_recategorising(view.ledger(spark, sf).withColumn("category_version", F.expr("CASE WHEN k % 5 > 0 THEN CAST(k % 5 AS INT) END")), 3).select("txn_id")


@query(f"WITH {ACCOUNTS}, gone AS (SELECT 'A' || (c_custkey * 3) AS account_id FROM customer) SELECT account_id, is_active AND account_id NOT IN (SELECT account_id FROM gone) AS is_active FROM accounts UNION ALL SELECT account_id, NULL FROM gone WHERE account_id NOT IN (SELECT account_id FROM accounts)")
def deactivated_accounts(spark, sf):
    """Every account after every third has been closed, and the ids that no account has."""
    changed, unknown = books.deactivated(view.accounts(spark, sf), spark.read.parquet(f"{sf}/customer.parquet").selectExpr("concat('A', c_custkey * 3) AS account_id"))
    return changed.select("account_id", "is_active").unionByName(unknown.withColumn("is_active", F.lit(None).cast("boolean")))


@query(f"WITH {STATEMENTS} SELECT statement_id, CASE WHEN balance_minor % 4 = 0 THEN TIMESTAMP '1990-01-01' WHEN balance_minor % 4 = 1 THEN TIMESTAMP '1999-01-01' END AS parsed_at FROM statements")
def parsed_statements(spark, sf):
    rows = view.statements(spark, sf).withColumn("parsed_at", F.expr("CASE WHEN balance_minor % 4 = 0 THEN TIMESTAMP'1990-01-01' END"))
    return books.marked_parsed(rows, rows.where("balance_minor % 4 < 2").select("statement_id"), "1999-01-01")[0].select("statement_id", "parsed_at")


@query(f"WITH {ACCOUNTS} SELECT account_id, CASE WHEN currency = 'USD' THEN balance_minor + apr_bp END AS total, CASE WHEN currency = 'USD' THEN balance_minor - apr_bp END AS difference, CASE WHEN currency = 'USD' THEN CAST(sign(balance_minor - apr_bp) AS INTEGER) END AS compared FROM accounts")
def guarded_amounts(spark, sf):
    of = (F.col("balance_minor"), F.col("currency"), F.col("apr_bp").cast("bigint"), F.lit("USD"))
    return view.accounts(spark, sf).select("account_id", money.add_minor(*of).alias("total"), money.subtract_minor(*of).alias("difference"), money.compare_minor(*of).alias("compared"))


@query("SELECT o_orderkey, '- ' || chr(CAST(65 + o_orderkey % 26 AS INTEGER)) || ' &lt; ' || chr(CAST(945 + o_orderkey % 20 AS INTEGER)) || ' &unknown; ' || chr(39) || 'é' || chr(39) AS decoded FROM orders")
def decoded_entities(spark, sf):
    raw = F.expr("concat('&NDash; &#', CAST(65 + o_orderkey % 26 AS STRING), '; &amp;lt; &#x', lower(hex(945 + o_orderkey % 20)), '; &unknown; &lsquo;é&rsquo;')")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", text.decode_entities(raw).alias("decoded"))


@query(f"WITH {LEDGER} SELECT owner_id || ':' || currency || ':' || strftime(posted_at, '%Y-%m') AS insight_id, txn_id AS evidence_id FROM ledger WHERE k % 5 = 0")
def dangling_evidence(spark, sf):
    ids = view.ledger(spark, sf).where("k % 5 <> 0").select(F.lit("transaction").alias("kind"), F.col("txn_id").alias("evidence_id"))
    return insights.dangling_evidence(_cited(spark, sf)[1], ids).select("insight_id", "evidence_id")


@query(f"WITH {LEDGER} SELECT account_id, posted_at AS day, string_agg(txn_id, ',' ORDER BY amount_minor >= 0, txn_id) AS events FROM ledger GROUP BY ALL")
def day_events(spark, sf):
    rows = view.ledger(spark, sf).selectExpr("account_id", "posted_at AS day", "txn_id AS id", "CASE WHEN amount_minor < 0 THEN 'outflow' ELSE 'inflow' END AS direction")
    return cashflow.day_events(rows).withColumn("events", F.array_join("events", ","))


@query(f"WITH {ACCOUNTS}, a AS (SELECT owner_id, unnest(['kind ' || kind, 'currency ' || currency]) AS one FROM accounts) SELECT owner_id, string_agg(DISTINCT one, ';' ORDER BY one) AS assumptions FROM a GROUP BY owner_id")
def owner_assumptions(spark, sf):
    rows = view.accounts(spark, sf).selectExpr("owner_id", "array(concat('kind ', kind), concat('currency ', currency)) AS assumptions")
    return cashflow.all_assumptions(rows, ["owner_id"]).withColumn("assumptions", F.array_join("assumptions", ";"))


@query(f"WITH {STATEMENTS} SELECT statement_id FROM statements JOIN accounts USING (account_id) WHERE minimum_due_minor IS NOT NULL AND statements.currency <> CASE WHEN region = 'US' AND apr_bp > 0 THEN 'USD' ELSE 'INR' END")
def disagreeing_currencies(spark, sf):
    other = view.accounts(spark, sf).selectExpr("account_id", "CASE WHEN region = 'US' AND apr_bp > 0 THEN 'USD' ELSE 'INR' END AS minimum_currency")
    return quality.check_rows(view.statements(spark, sf).join(other, "account_id"), quality.agreeing_currencies()).select("statement_id")


@query(f"WITH {LOTS} SELECT account_id, instrument_id, acquired_at FROM lots WHERE NOT (units_micro > 0 AND cost_minor >= 0)")
def lot_violations(spark, sf):
    return quality.check_rows(view.lots(spark, sf), quality.lot_rules()).select("account_id", "instrument_id", "acquired_at")
