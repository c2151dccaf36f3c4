"""Mailbox sync: batches of landed messages through routing into the ledger; commit, then advance.

Every batch leaves records in ``sync_batches``: *open* before its first sink, *closed* after its last
one, *failed* where a sink gave up. The cursor and the state are read out of closed records, so
nothing has to be updated in place and a batch that died between two sinks is simply not closed: the
next pass takes the same messages again. Sinks leave out keys that their table has, so the second
time adds what was missing and nothing twice. A message that no template can read is stored and
passed; only storage stops a batch.

Identity is provenance (``message_id``, ``dedupe_key``) and is held against the store, not against a
watermark: late and repeated messages of any age are right. When a statement's lines arrive after
the alerts they tell of, or an alert after its line, ``supersede`` marks the alerts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerspark.functions.identity import dedupe_key
from ledgerspark.operators import ingest
from ledgerspark.operators.reconcile import reconcile
from ledgerspark.sources.tables import SCHEMAS, append, fetch_since, read_table, stored_messages

#: Sources whose lines outrank alerts.
AUTHORITATIVE = ("statement_pdf", "csv_import")
MESSAGE = "uid bigint, message_id string, from_header string, subject string, received_at timestamp, text string, html string, headers map<string,string>"


class Batch(NamedTuple):
    """What a sink gets: the batch's messages, outcomes, facts with their accounts, and the accounts that they make."""

    spark: SparkSession
    root: str
    messages: DataFrame
    outcomes: DataFrame
    facts: DataFrame
    new_accounts: DataFrame
    as_of: object


Sink = tuple[str, Callable[[Batch], None]]


class SyncResult(NamedTuple):
    ok: bool
    fetched: int
    parsed: int
    ignored: int
    quarantined: int
    facts: int
    generation: int
    last_uid: int
    has_more: bool
    reset: bool
    error: str | None


class MailboxSource(Protocol):
    """Messages by ascending uid; another generation makes all earlier uids void."""

    def generation(self) -> int: ...

    def fetch_since(self, after: int, limit: int) -> DataFrame: ...


@dataclass(frozen=True)
class ParquetMailbox:
    """A mailbox of landed Parquet files."""

    spark: SparkSession
    path: str
    current: int = 1

    def generation(self) -> int:
        return self.current

    def fetch_since(self, after: int, limit: int) -> DataFrame:
        return fetch_since(self.spark, self.path, after, limit)


def _into(table: str, rows: Callable[[Batch], DataFrame]) -> Sink:
    return table, lambda b: append(b.spark, b.root, table, rows(b))


def _failures(b: Batch) -> DataFrame:
    return ingest.parse_failures(b.outcomes).join(b.outcomes.select("message_id", "uid", "received_at"), "message_id")


def _accounts(b: Batch) -> DataFrame:
    return b.new_accounts.withColumns({"owner_id": F.lit(None).cast("string"), "region": F.lit(None).cast("string")})


#: Accounts come before what points at them.
SINKS: tuple[Sink, ...] = (
    _into("raw_messages", lambda b: stored_messages(b.messages)),
    _into("parse_failures", _failures),
    _into("accounts", _accounts),
    _into("transactions", lambda b: ingest.ledger_rows(b.facts)),
    _into("statements", lambda b: ingest.statement_rows(b.facts, b.as_of)),
    _into("balances", lambda b: ingest.balance_rows(b.facts)),
    ("supersede_marks", lambda b: supersede(b.spark, b.root, ingest.ledger_rows(b.facts).select("account_id", "currency", "posted_at"), b.as_of)),
)


def _attempts(log: DataFrame) -> DataFrame:
    """One row per attempt: its last record, and whether it was closed or failed."""
    phase = lambda p: F.max(F.col("phase") == p)
    last = F.max_by(F.struct("generation", "highest_uid", "at", "detail"), F.when(F.col("phase") == "open", 0).otherwise(1))
    return log.groupBy("mailbox", "attempt").agg(last.alias("r"), phase("closed").alias("closed"), phase("failed").alias("failed")).select("mailbox", "attempt", "closed", "failed", "r.*")


def sync_state(spark: SparkSession, root: str) -> DataFrame:
    """mailbox, generation, last_uid, last_attempt, last_success, failures, quarantined, out of the batches' records.

    The generation and cursor are those of closed batches. Failures count attempts since the last closed one that failed, or that a later attempt found open.
    """
    attempts = _attempts(read_table(spark, root, "sync_batches"))
    done = attempts.where("closed").groupBy("mailbox").agg(F.max("attempt").alias("good"), F.max_by("generation", "attempt").alias("generation"), F.max("at").alias("last_success"))
    reached = attempts.where("closed").groupBy("mailbox", "generation").agg(F.max("highest_uid").alias("last_uid"))
    newest = attempts.groupBy("mailbox").agg(F.max("attempt").alias("newest"), F.max("at").alias("last_attempt"))
    bad = attempts.join(newest, "mailbox").join(done, "mailbox", "left").where("NOT closed AND attempt > coalesce(good, 0) AND (failed OR attempt < newest)")
    failures = bad.groupBy("mailbox").agg(F.count(F.lit(1)).cast("int").alias("failures"))
    depth = read_table(spark, root, "parse_failures").agg(F.count(F.lit(1)).alias("quarantined"))  # one row
    both = newest.join(done, "mailbox", "left").join(reached, ["mailbox", "generation"], "left").join(failures, "mailbox", "left").crossJoin(F.broadcast(depth))
    return both.select("mailbox", "generation", F.coalesce("last_uid", F.lit(0)).alias("last_uid"), "last_attempt", "last_success", F.coalesce("failures", F.lit(0)).alias("failures"), "quarantined")


def _record(spark: SparkSession, root: str, **values) -> None:
    schema = SCHEMAS["sync_batches"]
    row = tuple(values.get(f.split()[0]) for f in schema.split(", "))
    cast = [F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")]
    loose = schema.replace("at timestamp", "at string")
    spark.createDataFrame([row], loose).select(*cast).coalesce(1).write.mode("append").parquet(f"{root}/sync_batches")


def sync_batch(spark: SparkSession, messages: DataFrame, root: str, as_of, templates=None, authenticity: bool = True, mailbox: str = "INBOX", generation: int = 1, after_uid: int = 0, sinks: Sequence[Sink] = SINKS) -> SyncResult:
    """One batch through all sinks, between its open and its closed record. A sink that raises leaves a failed record and raises on.

    Messages are routed once: the routed rows are written to the staging folder, from which all sinks read. A sink is a
    name and a function of the ``Batch``; give ``(*SINKS, own)`` to add one.
    """
    last = _attempts(read_table(spark, root, "sync_batches").where(F.col("mailbox") == mailbox)).agg(F.max("attempt").alias("n")).first().n or 0
    told = {"mailbox": mailbox, "attempt": last + 1, "generation": generation, "after_uid": after_uid, "at": str(as_of)}
    _record(spark, root, phase="open", highest_uid=after_uid, **told)
    name = "routing"
    try:
        staging = f"{root}/_staging/{mailbox}-{told['attempt'] % 2}"
        ingest.routed_rows(messages, ingest.sender_rules(spark), templates, authenticity).write.mode("overwrite").parquet(staging)
        routed = ingest.split_routed(spark.read.parquet(staging))
        facts, fresh = ingest.resolve_accounts(routed.facts, read_table(spark, root, "accounts"))
        batch = Batch(spark, root, messages, routed.outcomes, facts, fresh, as_of)
        for name, sink in sinks:
            sink(batch)
        name = "counters"
        c = ingest.sync_counters(routed.outcomes).first()
    except Exception as error:
        _record(spark, root, phase="failed", highest_uid=after_uid, detail=f"{name}: {type(error).__name__}: {error}"[:2000], **told)
        raise
    highest = max(after_uid, c.highest_uid or 0)
    counts = {k: c[k] for k in ("fetched", "parsed", "ignored", "quarantined", "facts")}
    _record(spark, root, phase="closed", highest_uid=highest, **counts, **told)
    return SyncResult(True, **counts, generation=generation, last_uid=highest, has_more=False, reset=False, error=None)


def run_sync(source: MailboxSource, spark: SparkSession, root: str, now, batch_size: int = 200, mailbox: str = "INBOX", **options) -> SyncResult:
    """One pass from the cursor: another generation starts again from uid 0. A batch that fails moves no cursor."""
    found = sync_state(spark, root).where(F.col("mailbox") == mailbox).first()
    generation = source.generation()
    known = found is not None and found.generation is not None
    reset = known and found.generation != generation
    start = found.last_uid if known and not reset else 0
    try:
        done = sync_batch(spark, source.fetch_since(start, batch_size), root, now, mailbox=mailbox, generation=generation, after_uid=start, **options)
    except Exception as error:
        return SyncResult(False, 0, 0, 0, 0, 0, generation, start, False, reset, f"{type(error).__name__}: {error}")
    return done._replace(has_more=done.fetched == batch_size, reset=reset)


def sync_until_caught_up(source: MailboxSource, spark: SparkSession, root: str, now, max_passes: int = 50, **options) -> list[SyncResult]:
    """Passes until one fails or finds less than a whole batch."""
    done: list[SyncResult] = []
    while len(done) < max_passes and (not done or done[-1].has_more):
        done.append(run_sync(source, spark, root, now, **options))
    return done


def start_sync(spark: SparkSession, source_path: str, root: str, checkpoint: str, as_of, files_per_batch: int = 100, once: bool = True, generation: int = 1, **options) -> StreamingQuery:
    """Reads new files of landed messages. The store leaves out what it has, however late it comes; another generation has a checkpoint of its own, so it reads all files again."""
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(source_path)

    def batch(rows: DataFrame, _: int) -> None:
        sync_batch(rows.sparkSession, rows, root, as_of, generation=generation, **options)

    writer = stream.writeStream.option("checkpointLocation", f"{checkpoint}/generation-{generation}").foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def live_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Stored transactions with the marks of what superseded them."""
    marks = read_table(spark, root, "supersede_marks").select(F.col("txn_id").alias("dedupe_key"), F.col("superseded_by").alias("__by"))
    rows = read_table(spark, root, "transactions").join(marks, "dedupe_key", "left")
    return rows.withColumn("superseded_by", F.coalesce("superseded_by", "__by")).drop("__by")


def supersede(spark: SparkSession, root: str, arrived: DataFrame, now, window_days: int = 4, amount_drift_ratio: float = 0.0) -> None:
    """Marks stored alerts that a stored statement line tells of too, around the rows that arrived (account_id, currency, posted_at).

    Only accounts and days that the new rows can reach are read again; an alert that has a mark and a line that
    gave one take no part, so marks stay as they are and repeating it adds none.
    """
    reach = arrived.groupBy("account_id", "currency").agg(F.date_sub(F.min("posted_at"), window_days).alias("__from"), F.date_add(F.max("posted_at"), window_days).alias("__to"))
    near = live_ledger(spark, root).join(reach, ["account_id", "currency"]).where("posted_at BETWEEN __from AND __to").drop("__from", "__to")
    marks = read_table(spark, root, "supersede_marks")
    alerts = near.where("source = 'alert' AND superseded_by IS NULL").withColumnRenamed("dedupe_key", "txn_id")
    lines = near.where(F.col("source").isin(*AUTHORITATIVE)).withColumnRenamed("dedupe_key", "line_id").join(marks.select(F.col("superseded_by").alias("line_id")), "line_id", "left_anti")
    if lines.isEmpty() or alerts.isEmpty():
        return
    found = reconcile(alerts, lines, window_days, amount_drift_ratio).matched
    append(spark, root, "supersede_marks", found.select(F.col("alert").alias("txn_id"), F.col("line").alias("superseded_by"), "score", F.lit(str(now)).cast("timestamp").alias("marked_at")))


def import_lines(spark: SparkSession, root: str, lines: DataFrame, now, source: str = "statement_pdf", **options) -> None:
    """Statement lines (account_id, line_id, posted_at, amount_minor, currency, descriptor_raw, region) into the ledger, and the marks of the alerts that they supersede."""
    rows = lines.select(dedupe_key(F.lit(source), F.col("line_id"), F.lit(0)).alias("dedupe_key"), "account_id", "posted_at", "amount_minor", "currency", "descriptor_raw", "region", F.lit(source).alias("source"), F.col("line_id").alias("source_ref"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("superseded_by"))
    append(spark, root, "transactions", rows)
    supersede(spark, root, rows.select("account_id", "currency", "posted_at"), now, **options)


def freshness(state: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    """never, failing, stale or fresh for each mailbox, with the words for it."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_success")) / 60
    name = F.when(F.col("last_success").isNull(), "never").when(F.col("failures") > 0, "failing").when(age > minutes, "stale").otherwise("fresh")
    since = F.greatest(F.floor(age + 0.5), F.lit(0)).cast("bigint")
    hours = F.floor(since / 60 + 0.5).cast("bigint")
    gap = F.when(since < 60, F.format_string("%dm ago", since)).when(hours < 24, F.format_string("%dh ago", hours)).otherwise(F.format_string("%dd ago", F.floor(hours / 24 + 0.5).cast("bigint")))
    label = F.when(name == "never", "Never synced").when(name == "failing", F.concat(F.format_string("Sync failing (%dx) — last success ", F.col("failures")), gap)).when(since < 1, "Synced just now").otherwise(F.concat(F.lit("Synced "), gap))
    return state.select("mailbox", name.alias("freshness"), age.alias("minutes"), "quarantined", label.alias("label"))
