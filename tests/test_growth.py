"""Work that grows no faster than the input."""

import datetime as dt
import random
import time

import numpy as np
from pyspark.sql import functions as F

from ledgerspark.functions import text
from ledgerspark.operators import _fit, ingest, reconcile, recurring
from test_ledger import _slow_peel


def _charges(n, seed):
    """Monthly charges of n subscribers of one merchant in one account."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        start, amount = 19000 + rng.randrange(28), rng.choice([1549, 1799, 2600])
        rows += [(start + 30 * k + rng.randrange(3), amount, f"t{c:05}-{k:02}") for k in range(24) if rng.random() < 0.95]
    return sorted(rows, key=lambda r: (r[0], r[2]))


def _peeled(rows):
    days, amounts, ids = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows]
    streams, left = _fit.peel(days, amounts, ids, 100, _fit.CADENCES, 0.02, 0.75, None)
    return [(c, [(ids[i], s) for i, s, _ in m], missed) for c, _, m, missed in streams], [ids[i] for i in left]


def test_dense_groups_agree_with_the_slow_model():
    for seed in range(4):
        rows = _charges(14, seed)
        assert _peeled(rows) == _slow_peel(rows, _fit.CADENCES, 100, 0.02, 0.75)


def test_a_group_of_sixteen_times_the_rows_takes_no_hundred_times_the_work():
    took = []
    for n in (200, 3200):
        begin = time.process_time()
        _peeled(_charges(n, 1))
        took.append(time.process_time() - begin)
    assert took[1] < 40 * took[0]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_merchant_is_normalised_once(spark):
    rows = spark.createDataFrame([("SQ *JOE'S 12", "US", 1), ("UPI//77/SWIGGY/9", "IN", 2), ("UPI/77/88", "IN", 3), ("##", "US", 4), (None, "US", 5), ("AMZN Mktp US*1A", None, 6)], "d string, region string, k int")
    named = rows.withColumn("key", text.merchant_key(F.col("d"), F.col("region")))
    assert [r.key for r in named.orderBy("k").collect()] == ["joe s 12", "swiggy", "77 88", "~raw:##", None, "amazon marketplace"]
    assert _plan(named).count("regexp_replace") <= 16


def test_rows_of_one_file_are_dealt_before_they_are_normalised(spark):
    rows = spark.createDataFrame([("t1", "a", dt.date(2024, 1, 5), -1549, "USD", "NETFLIX.COM", "US", None)], "txn_id string, account_id string, posted_at date, amount_minor bigint, currency string, descriptor_raw string, region string, kind string").coalesce(1)
    assert "RepartitionByExpression [txn_id" in _plan(recurring.detect_recurring(rows, "2024-02-15").excluded)


def test_messages_of_one_file_are_dealt_before_they_are_read(spark):
    rows = spark.createDataFrame([], "uid bigint, message_id string, from_header string, subject string, received_at timestamp, text string, html string, headers map<string,string>").coalesce(1)
    assert "RepartitionByExpression [uid" in ingest.routed_rows(rows, ingest.sender_rules(spark))._jdf.queryExecution().analyzed().toString()


def _reconcilable(spark, n):
    schema = "account_id string, {} string, posted_at date, amount_minor bigint, currency string, descriptor_raw string, region string"
    rows = lambda p, late: [("acc", f"{p}{i}", dt.date(1969, 11, 1) + dt.timedelta(i % 120 + late), 100 + i, "USD", "SQ *COFFEE 123", "US") for i in range(n)]
    return spark.createDataFrame(rows("a", 0), schema.format("txn_id")), spark.createDataFrame(rows("b", 4), schema.format("line_id"))


def test_days_are_dealt_into_spans(spark):
    alerts, lines = _reconcilable(spark, 240)  # days on both sides of 1970, each line four days late
    assert reconcile._candidates(alerts, lines, 4, 0.0).count() == 240
    assert reconcile._candidates(alerts, lines, 3, 0.0).count() == 0
    assert "floor" in reconcile._candidates(alerts, lines, 4, 0.0)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_pairs_without_rivals_are_written_once_and_reach_no_python(spark, monkeypatch):
    names = []
    real = reconcile.written
    monkeypatch.setattr(reconcile, "written", lambda df, name: (names.append(name), real(df, name))[1])
    alerts, lines = _reconcilable(spark, 240)
    assert reconcile.reconcile(alerts, lines).matched.count() == 240
    assert names == ["pairs", "rivals"]
