"""Ledger tables on Parquet, with explicit schemas and idempotent appends."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "accounts": "account_id string, owner_id string, institution string, kind string, currency string, region string, last4 string, display_name string, is_active boolean",
    "transactions": "dedupe_key string, account_id string, posted_at date, amount_minor bigint, currency string, descriptor_raw string, region string, source string, source_ref string, ordinal int, superseded_by string",
    "statements": "account_id string, period_start date, period_end date, balance_minor bigint, minimum_due_minor bigint, due_date date, currency string, statement_id string",
    "raw_messages": "message_id string, uid bigint, from_header string, subject string, received_at timestamp, text string, html string, headers map<string,string>, byte_size bigint, sha256 string",
    "parse_failures": "message_id string, uid bigint, reason string, detail string, received_at timestamp",
    "balances": "account_id string, currency string, balance_minor bigint, observed_on date, balance_type string, source_ref string",
    "supersede_marks": "txn_id string, superseded_by string, score bigint, marked_at timestamp",
    "sync_batches": "mailbox string, attempt bigint, phase string, generation bigint, after_uid bigint, highest_uid bigint, at timestamp, fetched bigint, parsed bigint, ignored bigint, quarantined bigint, facts bigint, detail string",
    "price_rejects": "line string, reason string, source string",
    "insights": "insight_id string, insight_kind string, text string, created_at timestamp, dismissed_at timestamp",
    "insight_evidence": "insight_id string, kind string, evidence_id string, ordinal int",
    "valuations": "instrument_id string, as_of_date date, price_minor_e4 bigint, source string",
    "fx_rates": "currency string, rate_date date, inr_per_usd_e4 bigint",
}
KEYS = {"accounts": ["account_id"], "transactions": ["dedupe_key"], "statements": ["statement_id"], "raw_messages": ["message_id"], "parse_failures": ["message_id"], "balances": ["account_id", "observed_on", "source_ref"], "supersede_marks": ["txn_id"], "insights": ["insight_id"], "insight_evidence": ["insight_id", "kind", "evidence_id"], "valuations": ["instrument_id", "as_of_date", "source"], "fx_rates": ["currency", "rate_date"]}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table's rows; none before the first append."""
    path = f"{root}/{name}"
    try:
        spark.read.format("text").load(path).schema  # noqa: B018
    except AnalysisException:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def append_new(batch: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows whose key is neither in the store nor earlier in the batch (the least row of a key counts)."""
    others = [c for c in batch.columns if c not in keys and not dict(batch.dtypes)[c].startswith("map")]
    order = F.struct(*others) if others else F.lit(0)
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), order).alias("x")).select("x.*")
    return first.join(store.select(*keys), keys, "left_anti")


def append(spark: SparkSession, root: str, name: str, batch: DataFrame) -> None:
    """Appends what is new; a batch that is written again adds nothing."""
    fresh = append_new(batch.select(*(c.split(":")[0] for c in spark.createDataFrame([], SCHEMAS[name]).columns)), read_table(spark, root, name), KEYS[name])
    fresh.write.mode("append").parquet(f"{root}/{name}")


def stored_messages(messages: DataFrame) -> DataFrame:
    """Raw messages with their size and digest."""
    body = F.coalesce("text", "html", F.lit(""))
    return messages.withColumns({"byte_size": F.octet_length(body).cast("bigint"), "sha256": F.sha2(body.cast("binary"), 256)})


def fetch_since(spark: SparkSession, path: str, after: int, limit: int) -> DataFrame:
    """Messages after a cursor in ascending uid, at most ``limit``."""
    return spark.read.parquet(path).where(F.col("uid") > after).orderBy("uid").limit(limit)


def read_csv_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV export (txn_id, account_id, posted_at, amount, currency, descriptor_raw), and those that cannot be read."""
    from ledgerspark.functions.money import parse_amount

    raw = spark.read.csv(path, header=True, schema="txn_id string, account_id string, posted_at string, amount string, currency string, descriptor_raw string, corrupt string", mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")
    rows = raw.withColumn("money", parse_amount(F.col("amount"), F.col("currency"))).withColumn("day", F.try_to_date("posted_at", "yyyy-MM-dd"))
    good = F.col("corrupt").isNull() & F.col("money.error").isNull() & F.col("day").isNotNull()
    return rows.where(good).select("txn_id", "account_id", F.col("day").alias("posted_at"), F.col("money.minor").alias("amount_minor"), "currency", "descriptor_raw", F.lit("csv_import").alias("source")), rows.where(~good).select("txn_id", "corrupt", F.col("money.error").alias("error"))


def read_nav_file(spark: SparkSession, path: str, source: str = "nav") -> tuple[DataFrame, DataFrame]:
    """Prices of a file ``instrument;name;price;dd-MMM-yyyy`` scaled by 10,000 minor units, and the lines that cannot be used, with the reason.

    A price with more than six decimals, a negative one and one that does not fit are rejected, never rounded or cut.
    """
    part = F.split("value", ";", 5)
    raw = spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("line"), F.array_size(part).alias("n"), *(F.trim(F.get(part, i)).alias(c) for i, c in enumerate(("instrument_id", "name", "price", "day"))))
    number = F.when(F.col("price").rlike(r"^\d{1,12}(\.\d{1,6})?$"), F.col("price").try_cast("decimal(20,6)") * 1_000_000)
    rows = raw.withColumns({"as_of_date": F.try_to_date("day", "dd-MMM-yyyy"), "price_minor_e4": number.cast("bigint")})
    reason = (
        F.when(F.col("n") != 4, "columns").when(F.col("instrument_id") == "", "no_instrument")
        .when(F.col("price_minor_e4").isNull(), "bad_price").when(F.col("as_of_date").isNull(), "bad_date")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason IS NULL").select("instrument_id", "as_of_date", "price_minor_e4", F.lit(source).alias("source"))
    return good, rows.where("reason IS NOT NULL").select("line", "reason", F.lit(source).alias("source"))


def import_prices(spark: SparkSession, path: str, root: str, source: str = "nav") -> None:
    """A price file into ``valuations`` (a stored price is never overwritten) and ``price_rejects``."""
    good, bad = read_nav_file(spark, path, source)
    append(spark, root, "valuations", good)
    bad.write.mode("append").parquet(f"{root}/price_rejects")
