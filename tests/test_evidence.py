"""Evidence of collisions, totals, fees and price steps; detectors; insights stored with their evidence or not at all."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import cashflow, debt, detectors, insights, price_steps, reports
from ledgerspark.sources.insight_store import read_insights, write_insights

D = dt.date


@pytest.fixture(scope="module")
def given(spark):
    requests = spark.createDataFrame([("a", D(2026, 8, 1), 30, 10000, 5000, "USD", 90), ("b", D(2026, 8, 1), 30, 100, 5000, "USD", 90)], "account_id string, today date, horizon_days int, opening_minor bigint, floor_minor bigint, currency string, max_deferral_days int")
    owed = spark.createDataFrame([("a", "z", D(2026, 8, 3), 4000), ("a", "card", D(2026, 8, 3), 2000), ("a", "late", D(2026, 8, 20), 7000), ("a", "before", D(2026, 8, 2), 500)], "account_id string, id string, due_on date, amount_minor bigint").selectExpr("*", "'USD' AS currency", "true AS movable", "CAST(NULL AS DATE) AS latest_move_to", "CAST(NULL AS BIGINT) AS minimum_due_minor", "CAST(NULL AS STRING) AS confidence")
    paid = spark.createDataFrame([("a", "pay", D(2026, 8, 5), 5000, "USD", None)], "account_id string, id string, expected_on date, amount_minor bigint, currency string, confidence string")
    flow = cashflow.project_cash_flow(requests, owed, paid)
    charges = [(f"t{i}", D(2026, 1 + i, 5), a) for i, a in enumerate([1549, 1549, 2600, 1549, 1799, 1799])]
    rows = spark.createDataFrame([("s", t, d, a, 100) for t, d, a in charges], "stream_key string, txn_id string, posted_at date, amount_minor bigint, floor_minor bigint")
    found = price_steps.detect_price_steps(rows, spark.createDataFrame([("s", "monthly", 1, "USD")], "stream_key string, kind string, interval int, currency string"))
    ledger = spark.createDataFrame([("f1", "o", "USD", D(2026, 7, 1), -500, "interest"), ("f2", "o", "USD", D(2026, 6, 1), -700, "interest"), ("old", "o", "USD", D(2025, 6, 1), -9, "interest"), ("n", "o", "USD", D(2026, 7, 1), -9, None)], "txn_id string, owner_id string, currency string, posted_at date, amount_minor bigint, fee_type string")
    return detectors.Inputs(reports.fee_evidence(ledger, D(2026, 8, 1)), found.steps, found.evidence, flow.collisions, flow.collision_events), ledger


def test_outflows_of_collisions(given):
    events = given[0].collision_events.orderBy("account_id", "from_day", "ordinal").collect()
    assert [(e.account_id, e.from_day, e.id, e.obligation, e.outflow_minor, e.ordinal) for e in events] == [
        ("a", D(2026, 8, 3), "card", True, 2000, 1), ("a", D(2026, 8, 3), "z", True, 4000, 2), ("a", D(2026, 8, 20), "late", True, 7000, 1),
    ]
    assert {(c.account_id, c.from_day) for c in given[0].collisions.collect()} == {("a", D(2026, 8, 3)), ("a", D(2026, 8, 20)), ("b", D(2026, 8, 1))}


def test_charges_of_price_steps(given):
    rows = given[0].step_evidence.orderBy("ordinal").collect()
    assert [(r.side, r.txn_id, r.ordinal, r.effective_from) for r in rows] == [(s, t, i, D(2026, 5, 5)) for i, (s, t) in enumerate([("before", "t0"), ("before", "t1"), ("before", "t3"), ("after", "t4"), ("after", "t5")], 1)]


def test_fees_and_their_rows_agree(given):
    total = reports.fee_ledger(given[1], D(2026, 8, 1)).collect()
    assert [(t.fee_minor, t.n) for t in total] == [(1200, 2)]
    assert {r.txn_id for r in given[0].fees.collect()} == {"f1", "f2"}


def test_accounts_of_debt_totals(spark):
    rows = [("new", 100, D(2026, 7, 30)), ("old", 100, D(2026, 1, 1)), ("none", None, None)]
    accounts = spark.createDataFrame([(i, "o", "USD", a, None, None, d, None, "high") for i, a, d in rows], "account_id string, owner_id string, currency string, owed_minor bigint, minimum_due_minor bigint, due_on date, observed_on date, apr_bp int, confidence string")
    found = debt.debt_map(accounts, D(2026, 8, 1))
    assert {(r.account_id, r.missing, r.stale) for r in debt.debt_evidence(found.positions).collect()} == {("new", False, False), ("old", False, True), ("none", True, False)}
    total = found.totals.first()
    assert (total.observed, total.total, total.missing, total.stale) == (2, 3, 1, 1)


def test_detectors_give_insights_with_evidence(given):
    found = detectors.detect(given[0])
    texts = {r.text for r in found.insights.collect()}
    assert texts == {"2 times interest cost 12.00 USD", "s went from 15.49 to 17.99 USD", "a is short of 1500 from 2026-08-03", "a is short of 3500 from 2026-08-20"}
    assert found.rejects.count() == 1  # account b is short without an outflow
    cited = {r.insight_id: r.n for r in found.evidence.groupBy("insight_id").agg(F.count("*").alias("n")).collect()}
    assert set(cited) == {r.insight_id for r in found.insights.collect()} and sorted(cited.values()) == [1, 2, 2, 5]
    assert detectors.detect(given[0], ["fees"]).insights.count() == 1
    with pytest.raises(ValueError, match="fees"):
        detectors.detector("fees")(None)


INSIGHT, EVIDENCE = "insight_id string, insight_kind string, text string, created_at timestamp, dismissed_at timestamp", "insight_id string, kind string, evidence_id string, ordinal int"


def test_insights_and_evidence_are_stored_together(spark, tmp_path):
    root = str(tmp_path)
    made = lambda *ids: spark.createDataFrame([(i, "k", f"text {i}", None, None) for i in ids], INSIGHT)
    cited = spark.createDataFrame([("i", "transaction", "t1", 3), ("i", "transaction", "t1", 1), ("i", "account", "t1", 2), ("j", "transaction", "t2", 1), ("gone", "transaction", "t9", 1)], EVIDENCE)
    assert [df.count() for df in read_insights(spark, root)] == [0, 0]

    def dies():
        raise OSError("disk full")

    with pytest.raises(OSError, match="disk full"):
        write_insights(spark, root, made("i"), cited, between=dies)
    assert [df.count() for df in read_insights(spark, root)] == [0, 0]
    assert write_insights(spark, root, made("i"), cited).count() == 0
    stored = read_insights(spark, root)
    assert {(r.kind, r.evidence_id, r.ordinal) for r in stored.evidence.collect()} == {("transaction", "t1", 1), ("account", "t1", 2)}
    again = spark.createDataFrame([("i", "k", "other", None, None), ("j", "k", "b", None, None), ("j", "k", "a", None, None), ("l", " ", "x", None, None)], INSIGHT)
    refused = write_insights(spark, root, again, cited)
    assert {(r.insight_id, r.reason) for r in refused.collect()} >= {("l", "blank")}
    stored = read_insights(spark, root)
    assert {(r.insight_id, r.text) for r in stored.insights.collect()} == {("i", "text i"), ("j", "a")}
    assert stored.evidence.count() == 3 and insights.dangling_evidence(stored.evidence, stored.evidence.select("kind", "evidence_id")).count() == 0
