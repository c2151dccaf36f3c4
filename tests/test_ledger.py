"""Golden cases of the ledger library, conservation, and helpers against slow models of ours."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import calendar, identity, money, text
from ledgerspark.operators import _fit, cashflow, holdings, ingest, insights, ledger, price_steps, quality, reconcile, recurring

D = dt.date


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first().x


def test_amounts(spark):
    cases = {"$1,234.56": 123456, "(45.23)": -4523, "-5": -500, "1,08,244.50": 10824450, "Rs.35882.00": 3588200, ".5": 50}
    rows = spark.createDataFrame(list(cases.items()), "t string, want bigint")
    assert all(r.m.minor == r.want for r in rows.select("want", money.parse_amount(F.col("t"), F.lit("USD")).alias("m")).collect())
    bad = spark.createDataFrame([("",), ("1.234",), ("1.2.3",), ("abc",), (None,)], "t string")
    assert all(r.m.error for r in bad.select(money.parse_amount(F.col("t"), F.lit("USD")).alias("m")).collect())
    assert one(spark, money.parse_amount(F.lit("1200"), F.lit("JPY"))["minor"]) == 1200
    assert one(spark, money.to_decimal_string(F.lit(-5), F.lit("USD"))) == "-0.05"


def test_dates_and_cadences(spark):
    assert one(spark, calendar.parse_slash_date(F.lit("12/07/26"), "DMY")) == D(2026, 7, 12)
    assert one(spark, calendar.parse_slash_date(F.lit("31/02/26"), "DMY")) is None
    assert one(spark, calendar.last_business_day(F.lit(D(2026, 5, 3)))) == D(2026, 5, 29)
    rows = spark.createDataFrame([(1, "monthly", 1, None, D(2026, 1, 31))], "id int, kind string, interval int, second_day string, anchor date")
    found = [r.occurs_on for r in calendar.expand_occurrences(rows, F.lit(D(2026, 1, 31)), F.lit(D(2026, 4, 30))).collect()]
    assert sorted(found) == [D(2026, 1, 31), D(2026, 2, 28), D(2026, 3, 31), D(2026, 4, 30)]


def test_calendar_agrees_with_the_helper(spark):
    day = dt.date(1970, 1, 1)
    rows, want = [], {}
    for n, (cadence, anchor) in enumerate(itertools.product(_fit.CADENCES, [D(2024, 1, 31), D(2023, 2, 5), D(2024, 2, 29)])):
        rows.append((n, cadence[0], cadence[1], cadence[2], anchor))
        slots = _fit.slots(cadence, (anchor - day).days, (D(2024, 3, 1) - day).days, (D(2025, 6, 30) - day).days)
        want[n] = [] if slots is None else [day + dt.timedelta(s) for s in slots.tolist()]
    df = spark.createDataFrame(rows, "id int, kind string, interval int, second_day string, anchor date")
    got = {}
    for r in calendar.expand_occurrences(df, F.lit(D(2024, 3, 1)), F.lit(D(2025, 6, 30))).collect():
        got.setdefault(r.id, []).append(r.occurs_on)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_descriptors(spark):
    cases = [("SQ *COFFEE BAR 4821", "US", "coffee bar"), ("AMZN Mktp US*RT4G9K2L1", "US", "amazon marketplace"), ("WHOLEFDS MKT", "US", "whole foods mkt"), ("UPI/SWIGGY/9284712", "IN", "swiggy"), ("DreamplugPaytechSol", "IN", "cred"), ("12345", "US", "~raw:12345"), ("ACME WIDGETS LLC", "US", "acme widgets")]
    rows = spark.createDataFrame(cases, "raw string, region string, want string")
    for r in rows.select("want", text.merchant_key(F.col("raw"), F.col("region")).alias("got")).collect():
        assert r.got == r.want
    assert one(spark, identity.dedupe_key(F.lit("a|1"), F.lit("b"), F.lit(0))) != one(spark, identity.dedupe_key(F.lit("a"), F.lit("1|b"), F.lit(0)))


def test_august_collision(spark):
    requests = spark.createDataFrame([("a", D(2026, 8, 1), 30, 179300, 10000, "USD", 90)], "account_id string, today date, horizon_days int, opening_minor bigint, floor_minor bigint, currency string, max_deferral_days int")
    schema = "account_id string, id string, due_on date, amount_minor bigint, currency string, movable boolean, latest_move_to date, minimum_due_minor bigint, confidence string"
    owed = spark.createDataFrame([("a", "card", D(2026, 8, 5), 150000, "USD", True, D(2026, 8, 20), None, None), ("a", "bill", D(2026, 8, 7), 94117, "USD", True, D(2026, 8, 25), None, None), ("a", "bad", D(2026, 8, 7), -1, "USD", True, None, None, None)], schema)
    paid = spark.createDataFrame([("a", "pay", D(2026, 8, 15), 280000, "USD", None)], "account_id string, id string, expected_on date, amount_minor bigint, currency string, confidence string")
    flow = cashflow.project_cash_flow(requests, owed, paid)
    hit = flow.collisions.collect()
    assert [(h.from_day, h.to_day, h.worst_minor, h.shortfall_minor) for h in hit] == [(D(2026, 8, 7), D(2026, 8, 15), -64817, 74817)]
    best = flow.remedies.orderBy("rank").collect()
    assert [(r.id, r.remedy, r.to_date, r.displacement) for r in best] == [("bill", "move_payment", D(2026, 8, 16), 9), ("card", "move_payment", D(2026, 8, 16), 11)]
    assert [r.reason for r in flow.rejects.collect()] == ["negative"]


LINE = "account_id string, {0} string, posted_at date, amount_minor bigint, currency string, descriptor_raw string, region string"


def _greedy(alerts, lines, window, ratio):
    """All pairs, sorted, taken while both are free."""
    pairs = sorted((abs(a[3] - b[3]) * 1000 + abs((a[2] - b[2]).days) * 10 + (a[5] != b[5]), a[2], a[1], b[2], b[1]) for a in alerts for b in lines if a[0] == b[0] and a[4] == b[4] and abs((a[2] - b[2]).days) <= window and abs(a[3] - b[3]) <= abs(a[3]) * ratio)
    used, out = set(), set()
    for _, _, a, _, b in pairs:
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.add((a, b))
    return out


@pytest.mark.parametrize("ratio", [0.0, 0.25])
def test_reconcile_agrees_with_all_pairs(spark, ratio):
    rng = random.Random(7)
    make = lambda p, n: [(rng.choice("xy"), f"{p}{i}", D(2026, 7, 1) + dt.timedelta(rng.randrange(40)), rng.choice([3600, 3600, 4000, 9000]), "USD", rng.choice(["COFFEE", "BOOKS"]), "US") for i in range(n)]
    alerts, lines = make("a", 60), make("b", 60)
    plan = reconcile.reconcile(spark.createDataFrame(alerts, LINE.format("txn_id")), spark.createDataFrame(lines, LINE.format("line_id")), amount_drift_ratio=ratio)
    got = {(r.alert, r.line) for r in plan.matched.collect()}
    assert got == _greedy(alerts, lines, 4, ratio)
    assert plan.unmatched_alerts.count() == 60 - len(got) and plan.unmatched_lines.count() == 60 - len(got)


@pytest.mark.parametrize("ratio", [0.0, 0.12])
@pytest.mark.parametrize("chunk", [9, 100_000])
def test_reconcile_splits_a_hot_account(spark, ratio, chunk):
    rng = random.Random(5)
    make = lambda p, n: [("hot" if i % 3 == 0 else f"c{i % 7}", f"{p}{i:03}", D(2026, 7, 1) + dt.timedelta(rng.randrange(30)), rng.choice([3600, 3600, 4000, -3600]), rng.choice(["USD", "EUR"]), rng.choice(["COFFEE", "BOOKS"]), "US") for i in range(n)]
    chain = [("chain", f"{p}c{i:03}", D(2026, 1, 1) + dt.timedelta(4 * i + 2 * (p == "b")), 500, "USD", "BUS", "US") for p in "ab" for i in range(60)]
    alerts, lines = make("a", 90) + [r for r in chain if r[1][0] == "a"], make("b", 90) + [r for r in chain if r[1][0] == "b"]
    plan = reconcile.reconcile(spark.createDataFrame(alerts, LINE.format("txn_id")), spark.createDataFrame(lines, LINE.format("line_id")), 2, ratio, chunk)
    assert {(r.alert, r.line) for r in plan.matched.collect()} == _greedy(alerts, lines, 2, ratio)


def test_reconcile_nothing(spark):
    none = spark.createDataFrame([], LINE.format("txn_id"))
    assert [df.count() for df in reconcile.reconcile(none, none.withColumnRenamed("txn_id", "line_id"))] == [0, 0, 0]


TXN = "txn_id string, account_id string, posted_at date, amount_minor bigint, currency string, descriptor_raw string, region string, kind string"


def _series(account, days, amounts, name="NETFLIX"):
    return [(f"{account}{i}", account, d, -a, "USD", name, "US", None) for i, (d, a) in enumerate(zip(days, amounts, strict=True))]


def test_recurring_golden_cases(spark):
    month = lambda n: [D(2026, m, 5) for m in range(1, n + 1)]
    rows = _series("monthly", month(6), [1549] * 6) + _series("lbd", [D(2026, 1, 30), D(2026, 2, 27), D(2026, 3, 31), D(2026, 4, 30), D(2026, 5, 29), D(2026, 6, 30)], [900] * 6)
    rows += _series("step", month(6), [1549] * 3 + [1799] * 3) + _series("skip", [D(2026, m, 5) for m in (1, 2, 4, 5, 6)], [1549] * 5)
    rows += _series("two", [d for d in month(4) for _ in (0, 1)], [999, 7999] * 4) + [("z", "monthly", D(2026, 3, 1), 0, "USD", "X", "US", None), ("p", "monthly", D(2026, 3, 1), -5, "USD", "CARD AUTOPAY", "US", None), ("r", "q", D(2026, 3, 1), -5, "ZAR", "X", "US", None), ("r2", "q", D(2026, 4, 1), -5, "ZAR", "X", "US", None)]
    found = recurring.detect_recurring(spark.createDataFrame(rows, TXN), D(2026, 6, 30))
    by = {}
    for s in found.streams.collect():
        by.setdefault(s.account_id, []).append(s)
    m = by["monthly"][0]
    assert (m.kind, m.interval, m.status, m.n, m.next_expected, m.confidence) == ("monthly", 1, "mature", 6, D(2026, 7, 5), "high")
    assert by["lbd"][0].kind == "last_business_day" and by["lbd"][0].n_missed == 0
    assert by["step"][0].breaches == 1 and by["skip"][0].n_missed == 1 and by["skip"][0].confidence == "medium"
    assert sorted((s.n, s.expected_minor) for s in by["two"]) == [(4, 999), (4, 7999)]
    assert {(r.txn_id, r.reason) for r in found.excluded.collect()} == {("z", "zero_amount"), ("p", "descriptor_heuristic")}
    assert {(r.txn_id, r.reason) for r in found.rejects.collect()} == {("r", "missing_floor"), ("r2", "missing_floor")}
    assert found.occurrences.count() + found.excluded.count() + found.unassigned.count() + found.rejects.count() == len(rows)
    steps = price_steps.detect_price_steps(found.occurrences, found.streams).steps.where("stream_key LIKE 'step%'").collect()
    assert [(s.effective_from, s.previous_minor, s.new_minor, s.annualised_minor, s.confidence) for s in steps] == [(D(2026, 4, 5), 1549, 1799, 3000, "high")]


def test_recurring_keeps_the_first_row_of_a_repeated_id(spark):
    days = [D(2026, m, 5) for m in range(1, 7)]
    rows = _series("a", days, [1549] * 3 + [1799] * 3)
    late = [(r[0], r[1], r[2] + dt.timedelta(days=9), r[3] - 1, *r[4:]) for r in rows[:2]]
    want = recurring.detect_recurring(spark.createDataFrame(rows, TXN), D(2026, 6, 30))
    found = recurring.detect_recurring(spark.createDataFrame(late + rows + rows[1:4], TXN), D(2026, 6, 30))
    assert found.streams.collect() == want.streams.collect() and want.streams.first().n == 6
    assert sorted(r.txn_id for r in found.occurrences.collect()) == [r[0] for r in rows]
    assert sorted((r.txn_id, r.reason) for r in found.rejects.collect()) == sorted((r[0], "duplicate_id") for r in late + rows[1:4])
    steps = price_steps.detect_price_steps(found.occurrences, found.streams).steps.collect()
    assert [(s.effective_from, s.previous_minor, s.new_minor) for s in steps] == [(D(2026, 4, 5), 1549, 1799)]


def test_price_levels():
    roles = lambda a: [r for r, _, _ in price_steps.split_levels(a, 100, 0.02, 2)]
    assert roles([1549, 1549, 2600, 1549]) == ["level", "level", "outlier", "level"]
    assert roles([1549, 1549, 1799]) == ["level", "level", "pending"]
    assert [n for _, n, _ in price_steps.split_levels([1549, 1549, 1799, 1799], 100, 0.02, 2)] == [0, 0, 1, 1]


MESSAGE = "uid bigint, message_id string, from_header string, subject string, received_at timestamp, text string, html string, headers map<string,string>"
PASS = {"authentication-results": "mx.google.com; spf=pass; dkim=pass; dmarc=pass"}


def _mail(uid, sender, body, headers=PASS, html=None):
    return (uid, f"m{uid}", sender, "Alert", dt.datetime(2026, 7, 15, 10), body, html, headers)


def test_routing_gives_each_message_one_outcome(spark):
    spend = "Rs.1,200.50 spent on your SBI Credit Card ending 1234 at SWIGGY on 12/07/26"
    rows = [
        _mail(1, "U.S. Bank <alerts@notifications.usbank.com>", None, html="<style>p{}</style><p>Your transaction of $12.34 is complete.&nbsp;</p>"),
        _mail(2, "onlinesbicard@sbicard.com", spend), _mail(3, "offers@sbicard.com", spend), _mail(4, "x@evil.com", spend), _mail(5, "not an address", spend),
        _mail(6, "onlinesbicard@sbicard.com", spend, {"authentication-results": "mx.google.com; dmarc=fail"}), _mail(7, "noreply@zolve.com", "hello"),
        _mail(8, "Chase <no.reply.alerts@chase.com>", "Statement balance: $2,709.80 Due date: 08/22/2026 Minimum payment due: $108.85"), _mail(9, "onlinesbicard@sbicard.com", spend.replace("12/07/26", "31/02/26")),
    ]
    routed = ingest.route_messages(spark.createDataFrame(rows, MESSAGE), ingest.sender_rules(spark))
    got = {r.uid: (r.status, r.reason) for r in routed.outcomes.collect()}
    assert got == {1: ("parsed", None), 2: ("parsed", None), 3: ("ignored", None), 4: ("ignored", None), 5: ("ignored", None), 6: ("quarantined", "failed_authenticity"), 7: ("quarantined", "no_parser_matched"), 8: ("parsed", None), 9: ("quarantined", "parser_extract_threw")}
    facts = {r.uid: r for r in routed.facts.collect()}
    assert facts[1].amount_minor == 1234 and facts[1].posted_at == D(2026, 7, 15)
    assert (facts[2].amount_minor, facts[2].currency, facts[2].posted_at, facts[2].descriptor_raw, facts[2].last4) == (120050, "INR", D(2026, 7, 12), "SWIGGY", "1234")
    assert (facts[8].amount_minor, facts[8].minimum_minor, facts[8].due_date) == (270980, 10885, D(2026, 8, 22))


def test_small_operators(spark):
    led = spark.createDataFrame([("a", None), ("b", None), ("c", "a")], "txn_id string, superseded_by string")
    plan = spark.createDataFrame([("a", "b"), ("b", "b"), ("x", "a"), ("c", "b")], "txn_id string, by string")
    done = ledger.apply_supersede(led, plan)
    assert {(r.txn_id, r.reason) for r in done.rejects.collect()} >= {("b", "self"), ("x", "unknown")}
    flows = spark.createDataFrame([("a", D(2024, 1, 1), -1000), ("a", D(2025, 1, 1), 1100), ("b", D(2024, 1, 1), 5)], "id string, on date, amount_minor bigint")
    rates = {r.id: r.rate for r in holdings.xirr(flows, ["id"]).collect()}
    assert abs(rates["a"] - 0.0997) < 1e-3 and rates["b"] is None
    texts = spark.createDataFrame([("i", "You spent 1,200 of 99")], "insight_id string, text string")
    facts = spark.createDataFrame([("i", "1200")], "insight_id string, figure string")
    assert [r.figure for r in insights.unsupported_figures(texts, facts).collect()] == ["99"]
    rows = spark.createDataFrame([(1, -1, "USD"), (1, 1, "??")], "id int, ordinal int, currency string")
    assert quality.check_unique(rows, ["id"]).count() == 1


def test_price_steps_take_announcements_in_order(spark):
    charges = [(f"t{i}", D(2024, 1 + i, 5), a) for i, a in enumerate([1000, 2000, 2000, 1000, 1000, 2000, 2000])]
    rows = spark.createDataFrame([("s", t, d, a, 100) for t, d, a in charges], "stream_key string, txn_id string, posted_at date, amount_minor bigint, floor_minor bigint")
    streams = spark.createDataFrame([("s", "monthly", 1, "USD")], "stream_key string, kind string, interval int, currency string")
    told = spark.createDataFrame([("s", "a1", D(2024, 1, 1), D(2024, 2, 5), 2000, "USD"), ("s", "a2", D(2024, 1, 2), D(2024, 2, 6), 2000, "USD")], "stream_key string, id string, announced_on date, effective_from date, new_minor bigint, currency string")
    plain = price_steps.detect_price_steps(rows, streams).steps.orderBy("effective_from").collect()
    assert [r.confidence for r in plain] == ["low", "medium", "medium"]
    got = price_steps.detect_price_steps(rows, streams, told, match_days=200).steps.orderBy("effective_from").collect()
    assert [(r.source, r.announcement_id) for r in got] == [("observed+announced", "a1"), ("observed", None), ("observed+announced", "a2")]


def test_conversion_takes_the_last_rate_on_or_before(spark):
    rng = random.Random(3)
    rates = [(c, D(2026, 1, 1) + dt.timedelta(d), 800000 + 7 * d) for c in ("INR", "EUR") for d in sorted(rng.sample(range(5, 400), 20))]
    rows = [(i, rng.choice(["INR", "EUR", "USD", "XXX", None]), rng.choice([None, *(D(2026, 1, 1) + dt.timedelta(x) for x in range(0, 600, 7))]), 10**6) for i in range(300)]
    got = holdings.convert(spark.createDataFrame(rows, "id int, currency string, day date, minor bigint"), spark.createDataFrame(rates, "currency string, rate_date date, inr_per_usd_e4 bigint"), "day", "minor").collect()
    assert len(got) == 300
    for r in got:
        last = max(((d, x) for c, d, x in rates if c == r.currency and r.day and d <= r.day), default=(None, None))
        assert (r.rate_date, r.inr_per_usd_e4) == last
        assert r.usd_minor == (10**6 if r.currency == "USD" else round(10**10 / last[1]) if last[1] else None)


def test_statements_cover_across_months(spark):
    rng = random.Random(4)
    periods = [(f"s{i}", rng.choice("ab"), D(2026, 1, 1) + dt.timedelta(20 * i), D(2026, 1, 1) + dt.timedelta(20 * i + rng.choice([-1, 0, 19, 75]))) for i in range(18)] + [("none", "a", None, D(2026, 5, 1))]
    rows = [(i, rng.choice(["a", "b", "c", None]), D(2025, 12, 20) + dt.timedelta(rng.randrange(500))) for i in range(200)]
    got = ledger.covering_statement(spark.createDataFrame(rows, "txn_id int, account_id string, posted_at date"), spark.createDataFrame(periods, "statement_id string, account_id string, period_start date, period_end date"))
    want = [(i, s) for i, a, d in rows for s in [s for s, b, x, y in periods if a == b and x and x <= d <= y] or [None]]
    assert sorted((r.txn_id, str(r.statement_id)) for r in got.collect()) == sorted((i, str(s)) for i, s in want)


def _slow_peel(rows, cadences, floor, rel, coherence):
    """Every cadence, slot by slot and row by row, as the rules read; rows are (day, amount, id)."""
    rows, out = sorted(rows, key=lambda r: (r[0], r[2])), []
    while len(rows) >= 2:
        fits = []
        for k, cadence in enumerate(cadences):
            expected = _fit.slots(cadence, rows[0][0], rows[0][0], rows[-1][0])
            if expected is None:
                continue
            used, level, matched, missed, breaches, deviation = set(), None, [], [], 0, 0
            for slot in expected.tolist():
                pool = [r for r in rows if abs(r[0] - slot) <= _fit.tolerance_days(cadence) and r[2] not in used]
                if not pool:
                    missed.append(slot)
                    continue
                good = [r for r in pool if level is not None and abs(r[1] - level) <= max(int(level * rel + 0.5), floor)]
                breaches += level is not None and not good
                r = min(good or pool, key=lambda r: (abs(r[0] - slot), r[1], r[2]))
                used.add(r[2])
                matched.append((r[2], slot))
                deviation, level = deviation + abs(r[0] - slot), r[1]
            if len(matched) >= 2:
                fits.append((-len(matched), len(missed), breaches, deviation, k, matched, missed))
        fits = [f for f in sorted(fits, key=lambda f: f[:5]) if 1 - f[2] / -f[0] >= coherence]
        if not fits:
            break
        out.append((cadences[fits[0][4]], fits[0][5], fits[0][6]))
        rows = [r for r in rows if r[2] not in {i for i, _ in fits[0][5]}]
    return out, [r[2] for r in rows]


def test_fit_agrees_with_a_slow_model():
    rng = random.Random(9)
    for _ in range(120):
        rows, n = [], 0
        for _ in range(rng.randrange(1, 4)):
            start, step, amount = 19700 + rng.randrange(60), rng.choice([7, 14, 28, 30, 31, 91]), rng.choice([999, 1549, 7999])
            for i in range(rng.randrange(1, 14)):
                if rng.random() < 0.85:
                    rows.append((start + i * step + rng.choice([0, 0, 0, 1, -1, 3]), amount + rng.choice([0, 0, 0, 5, 400]), f"t{n:03}"))
                    n += 1
        rows.sort(key=lambda r: (r[0], r[2]))
        if not rows:
            continue
        days, amounts, ids = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows]
        streams, left = _fit.peel(days, amounts, ids, 100, _fit.CADENCES, 0.02, 0.75, None)
        want, rest = _slow_peel(rows, _fit.CADENCES, 100, 0.02, 0.75)
        assert [(c, [(ids[i], s) for i, s, _ in m], missed) for c, _, m, missed in streams] == want and [ids[i] for i in left] == rest
