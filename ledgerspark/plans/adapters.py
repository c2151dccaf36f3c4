"""Ledger-shaped views over the driver's tables, each as DataFrame and as SQL text with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-08-02"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").selectExpr(
        "concat('A', c_custkey) AS account_id",
        "concat('O', c_custkey % 50) AS owner_id",
        "CASE c_custkey % 5 WHEN 0 THEN 'checking' WHEN 1 THEN 'savings' WHEN 4 THEN 'loan' ELSE 'credit_card' END AS kind",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'USD' ELSE 'INR' END AS currency",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'US' ELSE 'IN' END AS region",
        "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS last4",
        "c_custkey % 10 <> 9 AS is_active",
        "CAST(round(c_acctbal * 100) AS BIGINT) AS balance_minor",
        "CAST(c_custkey % 30 * 100 AS INT) AS apr_bp",
    ).where(key.isNotNull())


ACCOUNTS = """accounts AS (SELECT 'A' || c_custkey AS account_id, 'O' || (c_custkey % 50) AS owner_id,
  CASE c_custkey % 5 WHEN 0 THEN 'checking' WHEN 1 THEN 'savings' WHEN 4 THEN 'loan' ELSE 'credit_card' END AS kind,
  CASE WHEN c_nationkey % 2 = 0 THEN 'USD' ELSE 'INR' END AS currency, CASE WHEN c_nationkey % 2 = 0 THEN 'US' ELSE 'IN' END AS region,
  lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS last4, c_custkey % 10 <> 9 AS is_active,
  CAST(round(c_acctbal * 100) AS BIGINT) AS balance_minor, CAST(c_custkey % 30 * 100 AS INTEGER) AS apr_bp FROM customer)"""

_DESCRIPTOR = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN {c}('SQ *COFFEE BAR ', CAST(o_orderkey % 9000 AS {s})) WHEN '2' THEN 'AMZN Mktp US*RT4G9K2L1'
  WHEN '3' THEN 'WHOLEFDS MKT' WHEN '4' THEN 'UPI/SWIGGY/9284712' ELSE 'ACME WIDGETS LLC' END"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order, signed: money that leaves is negative."""
    held = accounts(spark, sf_dir).select("account_id", "owner_id", "currency", "region")
    rows = _read(spark, sf_dir, "orders").selectExpr(
        "concat('T', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS txn_id",
        "concat('A', o_custkey) AS account_id",
        "CAST(o_orderdate AS DATE) AS posted_at",
        "CASE WHEN o_orderstatus = 'P' THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor",
        _DESCRIPTOR.format(c="concat", s="STRING") + " AS descriptor_raw",
        "'alert' AS source",
        "concat('msg-', o_orderkey) AS source_ref",
        "0 AS ordinal",
        "o_orderkey AS k",
    )
    return rows.join(held, "account_id")


LEDGER = (
    ACCOUNTS
    + """, ledger AS (SELECT 'T' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS txn_id, 'A' || o_custkey AS account_id, CAST(o_orderdate AS DATE) AS posted_at,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor, """
    + _DESCRIPTOR.format(c="concat", s="VARCHAR")
    + """ AS descriptor_raw, 'alert' AS source, 'msg-' || o_orderkey AS source_ref, 0 AS ordinal, o_orderkey AS k, owner_id, currency, region
  FROM orders JOIN accounts ON accounts.account_id = 'A' || o_custkey)"""
)


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements say of most transactions: some days later, and every 11th a tenth more."""
    return ledger(spark, sf_dir).where("k % 13 <> 0").selectExpr(
        "concat('L', txn_id) AS line_id",
        "account_id",
        "date_add(posted_at, CAST(k % 6 AS INT)) AS posted_at",
        "CASE WHEN k % 11 = 0 THEN amount_minor + amount_minor DIV 10 ELSE amount_minor END AS amount_minor",
        "currency",
        "descriptor_raw",
        "region",
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).groupBy("account_id", "currency", F.date_format("posted_at", "yyyy-MM").alias("month"))
    made = rows.agg(F.min("posted_at").alias("period_start"), F.max("posted_at").alias("period_end"), F.abs(F.sum("amount_minor")).alias("balance_minor"))
    return made.selectExpr(
        "concat(account_id, '-', month) AS statement_id",
        "account_id",
        "currency",
        "period_start",
        "period_end",
        "balance_minor",
        "CASE WHEN CAST(substr(account_id, 2) AS BIGINT) % 3 = 0 THEN NULL ELSE balance_minor DIV 25 END AS minimum_due_minor",
        "date_add(period_end, 21) AS due_date",
    )


STATEMENTS = (
    LEDGER
    + """, statements AS (SELECT account_id || '-' || month AS statement_id, account_id, currency, period_start, period_end, balance_minor,
  CASE WHEN CAST(substr(account_id, 2) AS BIGINT) % 3 = 0 THEN NULL ELSE balance_minor // 25 END AS minimum_due_minor, period_end + 21 AS due_date
  FROM (SELECT account_id, currency, strftime(posted_at, '%Y-%m') AS month, min(posted_at) AS period_start, max(posted_at) AS period_end,
    CAST(abs(sum(amount_minor)) AS BIGINT) AS balance_minor FROM ledger GROUP BY ALL))"""
)


def recurring_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years of monthly charges per customer, several customers to an account, with steps, spikes and gaps."""
    rows = _read(spark, sf_dir, "customer").selectExpr("c_custkey AS c", "explode(sequence(0, 23)) AS k").where("(c + k) % 17 <> 0")
    return rows.selectExpr(
        "concat('R', c, '-', k) AS txn_id",
        "concat('A', c % 300) AS account_id",
        "date_add(add_months(date_sub(DATE'2022-01-31', CAST(c % 28 AS INT)), k), CAST((c + k) % 3 AS INT)) AS posted_at",
        "-CAST(CASE WHEN c % 7 = 0 AND k = 9 THEN 2600 WHEN c % 5 = 0 AND k >= 12 THEN 1799 ELSE 1549 END AS BIGINT) AS amount_minor",
        "'USD' AS currency",
        "CASE c % 4 WHEN 0 THEN 'NETFLIX.COM' WHEN 1 THEN 'SPOTIFY USA' WHEN 2 THEN 'ACME GYM LLC' ELSE 'CLOUD STORAGE INC' END AS descriptor_raw",
        "'US' AS region",
        "CAST(NULL AS STRING) AS kind",
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "concat('S', l_suppkey) AS account_id", "concat('P', l_partkey) AS instrument_id", "CAST(round(l_quantity * 1e6) AS BIGINT) AS units_micro",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_minor", "'USD' AS currency", "CAST(l_shipdate AS DATE) AS acquired_at",
    )


LOTS = """lots AS (SELECT 'S' || l_suppkey AS account_id, 'P' || l_partkey AS instrument_id, CAST(round(l_quantity * 1e6) AS BIGINT) AS units_micro,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_minor, 'USD' AS currency, CAST(l_shipdate AS DATE) AS acquired_at FROM lineitem)"""


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly prices (scaled by 10,000 minor units) of two thirds of the parts."""
    return _read(spark, sf_dir, "part").where("p_partkey % 3 <> 0").selectExpr("p_partkey", "p_retailprice", "explode(sequence(0, 24)) AS m").selectExpr(
        "concat('P', p_partkey) AS instrument_id", "add_months(DATE'1993-01-01', m * 3) AS as_of_date", "CAST(round(p_retailprice * 1e6) AS BIGINT) + m * (p_partkey % 7) AS price_minor_e4",
    )


VALUATIONS = """valuations AS (SELECT 'P' || p_partkey AS instrument_id, CAST(DATE '1993-01-01' + to_months(CAST(m * 3 AS INTEGER)) AS DATE) AS as_of_date,
  CAST(round(p_retailprice * 1e6) AS BIGINT) + m * (p_partkey % 7) AS price_minor_e4 FROM part, range(0, 25) r(m) WHERE p_partkey % 3 <> 0)"""


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INR to USD each Monday over the orders' years, from the span of the orders themselves."""
    span = _read(spark, sf_dir, "orders").selectExpr("CAST(min(o_orderdate) AS DATE) AS a", "CAST(max(o_orderdate) AS DATE) AS b")
    days = span.selectExpr("explode(sequence(date_sub(a, 7), b)) AS rate_date").where("dayofweek(rate_date) = 2")
    return days.selectExpr("'INR' AS currency", "rate_date", "CAST(800000 + datediff(rate_date, DATE'1990-01-01') % 97 * 1000 AS BIGINT) AS inr_per_usd_e4")


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").selectExpr(
        "concat('E', user_id) AS account_id", "CAST(ts AS DATE) AS day", "event_type",
        "CAST(round(abs(value) * 100) AS BIGINT) AS amount_minor",
    )
    return rows.where("event_type IN ('purchase', 'error', 'signup')").selectExpr("account_id", "day", "CASE WHEN event_type = 'signup' THEN 'inflow' ELSE 'outflow' END AS direction", "amount_minor")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mailbox of six templates, and authentication headers that pass, fail, are missing or untrusted."""
    amount = "format_number(CAST(o_totalprice AS DECIMAL(18, 2)), 2)"
    body = f"""CASE o_orderkey % 6
      WHEN 0 THEN concat('Your transaction of $', {amount}, ' is complete. Card ending in ', lpad(CAST(o_custkey % 10000 AS STRING), 4, '0'))
      WHEN 1 THEN concat('Statement balance: $', {amount}, ' Minimum payment due: $25.00 Due date: ', date_format(o_orderdate, 'MM/dd/yyyy'))
      WHEN 2 THEN concat('Rs.', {amount}, ' spent on your SBI Credit Card ending ', lpad(CAST(o_custkey % 10000 AS STRING), 4, '0'), ' at SWIGGY on ', date_format(o_orderdate, 'dd/MM/yy'))
      WHEN 3 THEN concat('Statement for the credit card covering transactions from ', date_format(date_sub(o_orderdate, 30), 'MM/dd/yyyy'), ' to ', date_format(o_orderdate, 'MM/dd/yyyy'), ' Total Due: $', {amount}, ' Min Due: $10.00')
      WHEN 4 THEN 'Big savings on your next card' ELSE 'A template nobody knows' END"""
    sender = "CASE o_orderkey % 6 WHEN 0 THEN 'US Bank <alerts@notifications.usbank.com>' WHEN 1 THEN 'Chase <no.reply.alerts@chase.com>' WHEN 2 THEN 'onlinesbicard@sbicard.com' WHEN 3 THEN 'Zolve <noreply@zolve.com>' WHEN 4 THEN 'Deals <offers@chase.com>' ELSE 'noreply@zolve.com' END"
    auth = "CASE WHEN o_orderkey % 10 < 7 THEN 'mx.google.com; spf=pass; dkim=pass; dmarc=pass' WHEN o_orderkey % 10 = 7 THEN 'mx.google.com; dmarc=fail' WHEN o_orderkey % 10 = 8 THEN 'evil.example; dmarc=pass' END"
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS uid", "concat('m', o_orderkey) AS message_id", f"{sender} AS from_header", "'Your account' AS subject",
        "CAST(o_orderdate AS TIMESTAMP) AS received_at", f"{body} AS text", "CAST(NULL AS STRING) AS html", f"map('authentication-results', {auth}) AS headers",
    )
