"""The sync's promises: late mail, batches that die, generations, fact kinds, supersession, rejects."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import ingest
from ledgerspark.sources.tables import import_prices, read_nav_file, read_table
from ledgerspark.streaming import sync

D = dt.date
PASS = {"authentication-results": "mx.google.com; spf=pass; dkim=pass; dmarc=pass"}
NOW = dt.datetime(2026, 8, 1, 12)


def mail(uid, body, sender="onlinesbicard@sbicard.com", at=dt.datetime(2026, 7, 15, 10), headers=PASS, message_id=None):
    return (uid, message_id or f"m{uid}", sender, "Alert", at, body, None, headers)


def spent(rupees, day="12/07/26"):
    return f"Rs.{rupees}.00 spent on your SBI Credit Card ending 1234 at SWIGGY on {day}"


def land(spark, path, *rows):
    spark.createDataFrame(list(rows), sync.MESSAGE).coalesce(1).write.mode("append").parquet(str(path))


def ledger(spark, root):
    return sorted((r.source_ref, r.amount_minor) for r in read_table(spark, root, "transactions").collect())


def test_mail_lands_however_late(spark, tmp_path):
    root = f"{tmp_path}/out"
    days = [dt.datetime(2026, 5, 10), dt.datetime(2026, 5, 11), dt.datetime(2026, 1, 1)]
    for uid, at in enumerate(days, 1):
        land(spark, tmp_path / "in", mail(uid, spent(uid), at=at))
        sync.start_sync(spark, f"{tmp_path}/in", root, f"{tmp_path}/check", NOW, files_per_batch=1).awaitTermination()
    land(spark, tmp_path / "in", mail(9, spent(1), at=days[0], message_id="m1"), mail(3, spent(3)))
    sync.start_sync(spark, f"{tmp_path}/in", root, f"{tmp_path}/check", NOW, files_per_batch=1).awaitTermination()
    assert ledger(spark, root) == [("m1", -100), ("m2", -200), ("m3", -300)]
    assert [read_table(spark, root, t).count() for t in ("raw_messages", "accounts")] == [3, 1]
    sync.start_sync(spark, f"{tmp_path}/in", root, f"{tmp_path}/check", NOW, generation=2).awaitTermination()
    assert len(ledger(spark, root)) == 3
    state = sync.sync_state(spark, root).first()
    assert (state.generation, state.last_uid, state.failures) == (2, 9, 0)


def dies(at):
    """The sinks, with one that raises put before the sink ``at``."""

    def fail(_):
        raise OSError("disk full")

    where = [name for name, _ in sync.SINKS].index(at)
    return (*sync.SINKS[:where], ("broken", fail), *sync.SINKS[where:])


def test_a_batch_that_dies_leaves_no_hole_and_nothing_twice(spark, tmp_path):
    root = f"{tmp_path}/out"
    land(spark, tmp_path / "in", *(mail(i, spent(i)) for i in range(1, 6)), mail(6, "Statement for the credit card Total Due: $9.00", "noreply@zolve.com"))
    box = sync.ParquetMailbox(spark, f"{tmp_path}/in")
    first = sync.run_sync(box, spark, root, NOW, batch_size=3)
    assert (first.ok, first.fetched, first.last_uid, first.has_more) == (True, 3, 3, True)
    for n, at in ((1, "accounts"), (2, "statements")):
        bad = sync.run_sync(box, spark, root, NOW, batch_size=3, sinks=dies(at))
        assert not bad.ok and bad.last_uid == 3 and "disk full" in bad.error
        state = sync.sync_state(spark, root).first()
        assert (state.failures, state.last_uid) == (n, 3)
        assert sync.freshness(sync.sync_state(spark, root), NOW).first().freshness == "failing"
    rest = sync.sync_until_caught_up(box, spark, root, NOW + dt.timedelta(days=1), batch_size=3)
    assert [(r.ok, r.fetched, r.facts) for r in rest] == [(True, 3, 3), (True, 0, 0)]
    assert ledger(spark, root) == [(f"m{i}", -100 * i) for i in range(1, 6)]
    assert [read_table(spark, root, t).count() for t in ("raw_messages", "statements", "accounts")] == [6, 1, 2]
    state = sync.sync_state(spark, root).first()
    assert (state.failures, state.last_uid, state.last_success) == (0, 6, NOW + dt.timedelta(days=1))
    assert sync.freshness(sync.sync_state(spark, root), NOW + dt.timedelta(days=1, minutes=31)).first().freshness == "stale"


def test_an_attempt_found_open_counts_as_failed(spark, tmp_path):
    root = f"{tmp_path}/out"
    told = {"mailbox": "INBOX", "generation": 1, "after_uid": 0, "highest_uid": 0, "at": str(NOW)}
    sync._record(spark, root, phase="open", attempt=1, **told)
    assert sync.sync_state(spark, root).first().failures == 0  # it may still run
    sync._record(spark, root, phase="open", attempt=2, **told)
    sync._record(spark, root, phase="failed", attempt=2, detail="x", **told)
    state = sync.sync_state(spark, root).first()
    assert (state.failures, state.last_success, state.generation) == (2, None, None)
    assert sync.freshness(sync.sync_state(spark, root), NOW).first().freshness == "never"


def test_another_generation_starts_again(spark, tmp_path):
    root = f"{tmp_path}/out"
    land(spark, tmp_path / "one", mail(7, spent(7)), mail(8, "no template knows this"))
    assert sync.run_sync(sync.ParquetMailbox(spark, f"{tmp_path}/one", 1), spark, root, NOW).last_uid == 8
    land(spark, tmp_path / "two", mail(1, spent(7), message_id="m7"), mail(2, spent(2), message_id="new"))
    done = sync.run_sync(sync.ParquetMailbox(spark, f"{tmp_path}/two", 2), spark, root, NOW)
    assert (done.reset, done.fetched, done.last_uid) == (True, 2, 2)
    assert ledger(spark, root) == [("m7", -700), ("new", -200)]
    state = sync.sync_state(spark, root).first()
    assert (state.generation, state.last_uid, state.quarantined) == (2, 2, 1)


def test_poison_is_stored_and_passed(spark, tmp_path):
    root = f"{tmp_path}/out"
    land(spark, tmp_path / "in", mail(1, "no template knows this"), mail(2, spent(2, "31/02/26")), mail(3, spent(3), headers={}), mail(4, spent(4)), mail(5, spent(5), "x@evil.example"))
    done = sync.run_sync(sync.ParquetMailbox(spark, f"{tmp_path}/in"), spark, root, NOW)
    assert (done.fetched, done.parsed, done.ignored, done.quarantined, done.facts, done.last_uid) == (5, 1, 0, 4, 1, 5) or done.ignored == 1
    kept = {r.message_id: r.reason for r in read_table(spark, root, "parse_failures").collect()}
    assert kept["m1"] == "no_parser_matched" and kept["m2"] == kept["m3"] == "extract_threw"
    assert ledger(spark, root) == [("m4", -400)]


def test_an_own_sink_sees_the_batch(spark, tmp_path):
    land(spark, tmp_path / "in", mail(1, spent(1)))
    seen = []
    sync.run_sync(sync.ParquetMailbox(spark, f"{tmp_path}/in"), spark, f"{tmp_path}/out", NOW, sinks=(*sync.SINKS, ("mine", lambda b: seen.extend(ingest.facts_of(b.facts, "transaction").collect()))))
    assert [(r.amount_minor, r.direction, r.descriptor_raw, r.last4) for r in seen] == [(100, "debit", "SWIGGY", "1234")]


LINES = "account_id string, line_id string, posted_at date, amount_minor bigint, currency string, descriptor_raw string, region string"


def test_late_lines_and_late_alerts_supersede(spark, tmp_path):
    root = f"{tmp_path}/out"
    land(spark, tmp_path / "in", mail(1, spent(10, "12/07/26")), mail(2, spent(10, "20/07/26")), mail(3, spent(30, "12/07/26")))
    box = sync.ParquetMailbox(spark, f"{tmp_path}/in")
    sync.run_sync(box, spark, root, NOW)
    account = read_table(spark, root, "accounts").first().account_id
    lines = [(account, "l1", D(2026, 7, 14), -1000, "INR", "SWIGGY", "IN"), (account, "l2", D(2026, 7, 13), -5000, "INR", "SWIGGY", "IN"), ("other", "l3", D(2026, 7, 12), -3000, "INR", "SWIGGY", "IN")]
    marked = lambda: {r.source_ref: r.superseded_by for r in sync.live_ledger(spark, root).where("superseded_by IS NOT NULL").collect()}
    for _ in range(2):
        sync.import_lines(spark, root, spark.createDataFrame(lines, LINES), NOW)
        assert set(marked()) == {"m1"} and sync.live_ledger(spark, root).count() == 6
    before = marked()
    land(spark, tmp_path / "in", mail(4, spent(50, "12/07/26")), mail(5, spent(10, "14/07/26")))  # l2's alert comes late; l1 is taken
    sync.run_sync(box, spark, root, NOW)
    assert set(marked()) == {"m1", "m4"} and marked()["m1"] == before["m1"]


OTHER = [
    ingest.Template("pay", "Chase", "chase.com", "payment", "checking", "USD", (r"payment of",), {"amount": (r"payment of (\$[\d.,]+)", 1), "merchant": (r"(?:to|from) ([A-Z ]+) on", 1), "posted": (r"on (\d{2}/\d{2}/\d{4})", 1)}, ("merchant",), credit=r"received", labels={"status": "posted"}),
    ingest.Template("balance", "Chase", "chase.com", "balance", "checking", "USD", (r"available balance",), {"amount": (r"balance is (-?\$?-?[\d.,]+)", 1)}, labels={"balance_type": "available"}),
    ingest.Template("bill", "Chase", "chase.com", "bill_due", None, "USD", (r"bill from",), {"merchant": (r"bill from (\w+)", 1), "amount": (r"of (\$[\d.,]+)", 1), "due": (r"due (\d{2}/\d{2}/\d{4})", 1)}, ("due",), labels={"autopay": "true"}),
    ingest.Template("sub", "Chase", "chase.com", "subscription", None, "USD", (r"renewed",), {"merchant": (r"(\w+) renewed", 1), "amount": (r"for (\$[\d.,]+)", 1), "effective": (r"next (\d{2}/\d{2}/\d{4})", 1)}, ("effective",), labels={"cadence": "monthly", "event": "renewed"}),
    ingest.Template("price", "Chase", "chase.com", "price_change", None, "USD", (r"price goes",), {"merchant": (r"^\w+ (\w+) price", 1), "previous": (r"from (\$[\d.,]+)", 1), "amount": (r"to (\$[\d.,]+)", 1), "effective": (r"from (\d{2}/\d{2}/\d{4})", 1)}, ("effective", "previous")),
    ingest.Template("cancel", "Chase", "chase.com", "cancellation", None, "USD", (r"cancelled",), {"merchant": (r"(\w+) cancelled", 1), "amount": (r"refund (\$[\d.,]+)", 1), "refund": (r"refund (\$[\d.,]+)", 1)}),
    ingest.Template("refund", "Chase", "chase.com", "transaction", "credit_card", "USD", (r"charge|refunded",), {"amount": (r"(\$[\d.,]+)", 1), "merchant": (r"at ?(.*?) ?[.]", 1)}, ("merchant",), credit=r"refunded"),
]


def test_every_kind_of_fact(spark):
    bodies = ["You sent a payment of $12.00 to BOB SMITH on 07/02/2026", "We received a payment of $7.50 on 07/03/2026", "Your available balance is -$45.10", "Your bill from Hydro of $80.00 is due 09/01/2026", "Your bill from Hydro of $80.00", "Netflix renewed for $15.49 next 08/15/2026", "Netflix price goes from $15.49 to $17.99", "Netflix cancelled, refund $3.00", "charge of $5.00 at SHOP.", "refunded $6.00 at SHOP.", "charge of $5.00 at.", "charge of -$5.00x"]
    rows = [mail(i, b, "no.reply.alerts@chase.com") for i, b in enumerate(bodies)]
    routed = ingest.route_messages(spark.createDataFrame(rows, sync.MESSAGE), ingest.sender_rules(spark), OTHER)
    got = {r.uid: (r.status, r.detail) for r in routed.outcomes.collect()}
    assert got[4] == ("quarantined", "missing:due_date") and got[10] == ("quarantined", "empty:descriptor_raw")
    assert {u for u, (status, _) in got.items() if status == "parsed"} == set(range(12)) - {4, 10}
    one = lambda kind: [r.asDict() for r in ingest.facts_of(routed.facts, kind).orderBy("message_id").collect()]
    out, back = one("payment")
    assert (out["direction"], out["amount_minor"], out["counterparty_raw"], out["occurred_at"], out["status"]) == ("outbound", 1200, "BOB SMITH", D(2026, 7, 2), "posted")
    assert (back["direction"], back["counterparty_raw"], back["occurred_at_source"]) == ("inbound", None, "message")
    assert [(b["amount_minor"], b["balance_type"], b["observed_at"], b["observed_at_source"]) for b in one("balance")] == [(-4510, "available", D(2026, 7, 15), "received_at")]
    assert [(b["biller_raw"], b["due_date"], b["autopay"]) for b in one("bill_due")] == [("Hydro", D(2026, 9, 1), True)]
    assert [(b["merchant_raw"], b["cadence"], b["event"], b["next_charge_at"]) for b in one("subscription")] == [("Netflix", "monthly", "renewed", D(2026, 8, 15))]
    assert [(b["old_minor"], b["amount_minor"], b["effective_at"]) for b in one("price_change")] == [(1549, 1799, None)]
    assert [(b["merchant_raw"], b["refund_minor"]) for b in one("cancellation")] == [("Netflix", 300)]
    facts, _ = ingest.resolve_accounts(routed.facts, spark.createDataFrame([], "account_id string, institution string, currency string, kind string, last4 string, display_name string, is_active boolean"))
    assert {r.source_ref: (r.amount_minor, r.descriptor_raw) for r in ingest.ledger_rows(facts).collect()} == {"m0": (-1200, "BOB SMITH"), "m1": (750, "Payment"), "m8": (-500, "SHOP"), "m9": (600, "SHOP"), "m11": (-500, "Unknown")}


def test_rules_of_each_kind(spark):
    schema = "message_id string, source_message_id string, kind string, amount_minor bigint, minimum_minor bigint, original_minor bigint, posted_at date, due_date date, period_start date, period_end date, descriptor_raw string, last4 string, confidence double"
    day = D(2026, 7, 1)
    rows = [
        ("a", "a", "transaction", -1, None, -2, None, None, None, None, "", "12", 1.5), ("b", "x", "statement", None, None, None, None, None, day, D(2026, 6, 1), None, None, 0.5),
        ("c", "c", "payment", -5, None, None, day, None, None, None, None, None, 0.5), ("d", "d", "balance", -5, None, None, day, None, None, None, None, None, 0.5), ("e", "e", "gift", 5, None, None, day, None, None, None, None, None, 0.5), ("f", "f", "statement", -5, None, None, None, None, None, None, None, "1234", float("nan")),
    ]
    good, bad = ingest.validate_facts(spark.createDataFrame(rows, schema))
    assert [r.message_id for r in good.collect()] == ["d"]
    assert {r.message_id: set(r.broken) for r in bad.collect()} == {
        "a": {"confidence", "last4", "missing:posted_at", "negative:amount_minor", "negative:original_minor", "empty:descriptor_raw"}, "b": {"message_id", "period_order", "nothing_extracted"},
        "c": {"negative:amount_minor"}, "e": {"unknown_kind"}, "f": {"confidence"},
    }


def test_unknown_fields_and_kinds_are_refused(spark):
    with pytest.raises(ValueError, match="colour"):
        ingest.template_rules(spark, [ingest.Template("t", "B", "b.com", "payment", None, "USD", (), {"colour": ("x", 0)})])
    with pytest.raises(ValueError, match="gift"):
        ingest.template_rules(spark, [ingest.Template("t", "B", "b.com", "gift", None, "USD", (), {})])


def test_null_owners_keep_their_facts(spark):
    facts = spark.createDataFrame([(1, "m1", 0, None, "B", "USD", "1234", None), (2, "m2", 0, None, "B", "USD", None, "checking"), (3, "m3", 0, "o", "B", "USD", "1234", None), (4, "m4", 0, "o", None, None, None, None)], "uid bigint, message_id string, ordinal int, owner_id string, institution string, account_currency string, last4 string, account_kind string")
    held = spark.createDataFrame([("mine", None, "B", "USD", "checking", "9999", "x", True), ("card", None, "B", "USD", "credit_card", "1234", "y", True), ("shut", "o", "B", "USD", "credit_card", "1234", "y", False)], "account_id string, owner_id string, institution string, currency string, kind string, last4 string, display_name string, is_active boolean")
    found, made = ingest.resolve_accounts(facts, held)
    got = {r.uid: r.account_id for r in found.collect()}
    assert got[1] == "card" and got[2] == "mine" and got[3] == "o:B:USD:1234" and got[4].startswith("o:") and len(got) == 4
    assert {r.account_id for r in made.collect()} == {got[3], got[4]}


def test_prices_that_cannot_be_used_are_kept(spark, tmp_path):
    (tmp_path / "nav.txt").write_text("A;Fund;12.3456;01-Aug-2026\nB;Fund;-1;01-Aug-2026\nC;Fund;1.23456789;01-Aug-2026\nD;Fund;5;31-Feb-2026\nbroken line\n;x;1;01-Aug-2026\nE;Fund;5;02-Aug-2026;more\n\n")
    good, bad = read_nav_file(spark, str(tmp_path / "nav.txt"))
    assert [(r.instrument_id, r.price_minor_e4, r.as_of_date) for r in good.collect()] == [("A", 12345600, D(2026, 8, 1))]
    assert {(r.line.split(";")[0], r.reason) for r in bad.collect()} == {("B", "bad_price"), ("C", "bad_price"), ("D", "bad_date"), ("broken line", "columns"), ("", "no_instrument"), ("E", "columns")}
    import_prices(spark, str(tmp_path / "nav.txt"), f"{tmp_path}/out")
    (tmp_path / "nav.txt").write_text("A;Fund;99;01-Aug-2026\n")
    import_prices(spark, str(tmp_path / "nav.txt"), f"{tmp_path}/out")
    assert [r.price_minor_e4 for r in read_table(spark, f"{tmp_path}/out", "valuations").collect()] == [12345600]
    assert read_table(spark, f"{tmp_path}/out", "price_rejects").count() == 6
    assert read_table(spark, f"{tmp_path}/out", "valuations").select(F.max("as_of_date")).first()[0] == D(2026, 8, 1)
