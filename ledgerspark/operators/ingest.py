"""Messages to facts to ledger rows: gates, templates, routing, validation, accounts.

A template is data: a sender's domain, patterns, a date order, a currency and a confidence. Templates
are rows that meet the messages of their domain. Every message gets exactly one status.
"""

from __future__ import annotations

from dataclasses import dataclass, field as attribute
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.calendar import parse_slash_date, utc_date
from ledgerspark.functions.identity import dedupe_key
from ledgerspark.functions.money import as_map, parse_amounts
from ledgerspark.functions.text import domain_part, find_last4, local_part, message_text, parse_from_header

# Senders that may be read; no local parts means any.
SENDERS = [
    ("Chase", "US", "chase.com", ["no.reply.alerts"]),
    ("American Express", "US", "welcome.americanexpress.com", []),
    ("Discover", "US", "services.discover.com", []),
    ("U.S. Bank", "US", "notifications.usbank.com", []),
    ("Capital One", "US", "notification.capitalone.com", []),
    ("SBI Card", "IN", "sbicard.com", ["onlinesbicard", "statements"]),
    ("Zolve", "US", "zolve.com", ["noreply"]),
]
# Currency tokens before an amount.
CURRENCIES = {"rs.": "INR", "rs": "INR", "₹": "INR", "inr": "INR", "usd": "USD", "$": "USD", "aud": "AUD", "sgd": "SGD", "gbp": "GBP", "eur": "EUR", "aed": "AED"}
TRUSTED = ("mx.google.com",)
# The reason under which a failure is stored, for each reason of a quarantine.
STORED_REASONS = {
    "no_parser_matched": "no_parser_matched", "multiple_parsers_matched": "no_parser_matched", "parser_match_threw": "extract_threw", "parser_extract_threw": "extract_threw",
    "parser_produced_no_facts": "extract_threw", "invalid_fact": "validation_failed", "failed_authenticity": "extract_threw",
}
_AMOUNT = r"\$?\s?([\d,]+(?:\.\d{2})?)"


#: Fields that a template may read.
AMOUNTS, DAYS, WORDS = ("amount", "minimum", "original", "previous", "refund"), ("posted", "due", "start", "end", "effective"), ("token", "merchant")


@dataclass(frozen=True)
class Template:
    """One wording of one kind of message, as data.

    match: patterns that must all be found; fields: name (of ``AMOUNTS``, ``DAYS``, ``WORDS``) to (pattern, group),
    required unless named optional. A transaction is a debit and a payment outbound unless ``direction`` says
    otherwise or ``credit`` is found. labels: what the wording itself says of the fact (``KINDS`` has the names).
    """

    id: str
    institution: str
    domain: str
    kind: str
    account_kind: str | None
    currency: str
    match: tuple[str, ...]
    fields: dict[str, tuple[str, int]] = attribute(hash=False)
    optional: tuple[str, ...] = ()
    order: str = "MDY"
    confidence: float = 0.95
    direction: str | None = None
    credit: str | None = None
    labels: dict[str, str] = attribute(default_factory=dict, hash=False)
    version: int = 1


@dataclass(frozen=True)
class Kind:
    """What a kind of fact has (column to its name in the kind) and what it must keep to."""

    columns: dict[str, str] = attribute(hash=False)
    labels: dict[str, str] = attribute(default_factory=dict, hash=False)
    required: tuple[str, ...] = ()
    unsigned: tuple[str, ...] = ()
    not_empty: tuple[str, ...] = ()
    some_of: tuple[str, ...] = ()


_MONEY = {"amount_minor": "amount_minor", "currency": "currency"}
KINDS = {
    "transaction": Kind({**_MONEY, "posted_at": "posted_at", "posted_at_source": "posted_at_source", "direction": "direction", "descriptor_raw": "descriptor_raw", "original_minor": "original_minor"}, {}, ("posted_at",), ("amount_minor", "original_minor"), ("descriptor_raw",)),
    "statement": Kind({**_MONEY, "period_start": "period_start", "period_end": "period_end", "minimum_minor": "minimum_minor", "due_date": "due_date"}, {}, (), ("minimum_minor",), (), ("amount_minor", "minimum_minor", "due_date")),
    "balance": Kind({**_MONEY, "posted_at": "observed_at", "posted_at_source": "observed_at_source"}, {"balance_type": "string"}, ("posted_at",)),
    "payment": Kind({**_MONEY, "posted_at": "occurred_at", "posted_at_source": "occurred_at_source", "direction": "direction", "descriptor_raw": "counterparty_raw"}, {"status": "string"}, ("posted_at",), ("amount_minor",)),
    "bill_due": Kind({**_MONEY, "descriptor_raw": "biller_raw", "due_date": "due_date"}, {"autopay": "boolean"}, ("due_date",)),
    "subscription": Kind({**_MONEY, "descriptor_raw": "merchant_raw", "effective_on": "next_charge_at"}, {"cadence": "string", "event": "string"}),
    "price_change": Kind({**_MONEY, "descriptor_raw": "merchant_raw", "previous_minor": "old_minor", "effective_on": "effective_at"}, {"cadence": "string"}),
    "cancellation": Kind({"descriptor_raw": "merchant_raw", "effective_on": "effective_at", "refund_minor": "refund_minor", "currency": "currency"}),
}


# The wording of the senders' messages.
TEMPLATES = [
    Template("us-bank-alert", "U.S. Bank", "notifications.usbank.com", "transaction", None, "USD", (r"(?i)\btransaction of \$\s?([\d,]+(?:\.\d{2})?)\b", r"(?i)\bis complete\b"), {"amount": (r"(?i)\btransaction of \$\s?([\d,]+(?:\.\d{2})?)\b", 1)}, confidence=0.6),
    Template(
        "chase-statement", "Chase", "chase.com", "statement", "credit_card", "USD", (rf"(?i)\bstatement balance\b\s*:?\s*{_AMOUNT}", r"(?i)\bdue date\b\s*:?\s*(\d{1,2}/\d{1,2}/\d{2,4})"),
        {"amount": (rf"(?i)\bstatement balance\b\s*:?\s*{_AMOUNT}", 1), "minimum": (rf"(?i)\bminimum payment due\b\s*:?\s*{_AMOUNT}", 1), "due": (r"(?i)\bdue date\b\s*:?\s*(\d{1,2}/\d{1,2}/\d{2,4})", 1)}, ("minimum",), confidence=0.98,
    ),
    Template(
        "sbi-card-alert", "SBI Card", "sbicard.com", "transaction", "credit_card", "INR", (r"(?i)\bspent on your SBI\b", r"(?i)(?:^|[\s>])(Rs\.?|INR|USD|AUD|SGD|GBP|EUR|AED|₹|\$)\s?([\d,]+(?:\.\d{1,2})?)\s+spent\b"),
        {
            "token": (r"(?i)(?:^|[\s>])(Rs\.?|INR|USD|AUD|SGD|GBP|EUR|AED|₹|\$)\s?[\d,]+(?:\.\d{1,2})?\s+spent\b", 1), "amount": (r"(?i)(?:^|[\s>])(?:Rs\.?|INR|USD|AUD|SGD|GBP|EUR|AED|₹|\$)\s?([\d,]+(?:\.\d{1,2})?)\s+spent\b", 1),
            "posted": (r"(?i)spent on your SBI[\s\S]*?\bon (\d{1,2}/\d{1,2}/(?:\d{2}|\d{4}))\b", 1), "merchant": (r"(?i)spent on your SBI[\s\S]*?\bat\s+(.+?)\s+on \d{1,2}/\d{1,2}/(?:\d{2}|\d{4})\b", 1),
        }, ("merchant",), order="DMY",
    ),
    Template(
        "zolve-statement", "Zolve", "zolve.com", "statement", "credit_card", "USD", (r"(?i)statement for the credit card", rf"(?i)\btotal due\b\s*:?\s*{_AMOUNT}"),
        {
            "amount": (rf"(?i)\btotal due\b\s*:?\s*{_AMOUNT}", 1), "minimum": (rf"(?i)\bmin(?:imum)? due\b\s*:?\s*{_AMOUNT}", 1),
            "start": (r"(?i)covering transactions from\s+(\d{1,2}/\d{1,2}/\d{4})\s+to\s+\d{1,2}/\d{1,2}/\d{4}", 1), "end": (r"(?i)covering transactions from\s+\d{1,2}/\d{1,2}/\d{4}\s+to\s+(\d{1,2}/\d{1,2}/\d{4})", 1),
        }, ("minimum", "start", "end"),
    ),
]


def register_template(templates: list[Template], template: Template) -> list[Template]:
    """The list with one more template; ids are unique."""
    if any(t.id == template.id for t in templates):
        raise ValueError(f"template {template.id} is registered already")
    return [*templates, template]


_TEMPLATE = """domain string, candidates array<struct<id:string,version:int,kind:string,account_kind:string,currency:string,`order`:string,confidence:double,direction:string,credit:string,
  labels:map<string,string>,match:array<string>,fields:map<string,struct<pattern:string,grp:int>>,required:array<string>>>"""


def template_rules(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """domain, candidates: the templates of each sender's domain, as rows, so that their number changes no plan."""
    domains: dict[str, list[tuple]] = {}
    for t in templates:
        unknown = set(t.fields) - {*AMOUNTS, *DAYS, *WORDS}
        if unknown or t.kind not in KINDS:
            raise ValueError(f"template {t.id}: unknown {', '.join(sorted(unknown)) or t.kind}")
        required = [name for name in t.fields if name not in t.optional]
        domains.setdefault(t.domain, []).append((t.id, t.version, t.kind, t.account_kind, t.currency, t.order, float(t.confidence), t.direction, t.credit, t.labels, list(t.match), dict(t.fields), required))
    return spark.createDataFrame(list(domains.items()), _TEMPLATE)


def sender_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENDERS, "institution string, region string, domain string, localparts array<string>")


def classify_senders(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """address, institution, region and sender_reason (null where allowed). Domains must be equal; a suffix is not enough."""
    rows = messages.withColumn("address", parse_from_header(F.col("from_header")))
    rows = rows.withColumns({"domain": domain_part(F.col("address")), "local": local_part(F.col("address"))})
    rows = rows.join(rules, "domain", "left")
    reason = (
        F.when(F.col("address").isNull(), "unparseable_from_header")
        .when(F.col("localparts").isNull(), "domain_not_allowlisted")
        .when((F.size("localparts") > 0) & ~F.array_contains("localparts", F.col("local")), "localpart_not_allowlisted")
    )
    return rows.withColumn("sender_reason", reason).drop("localparts", "local")


def assess_authenticity(headers: Column, from_: Column, trusted=TRUSTED, allow_unauthenticated: bool = False) -> Column:
    """struct(trusted, reason) of the Authentication-Results header."""
    raw = F.trim(F.coalesce(headers["authentication-results"], headers["Authentication-Results"]))
    server = F.lower(F.regexp_extract(raw, r"^\s*([^\s;]+)", 1))
    verdict = lambda m: F.lower(F.regexp_extract(raw, rf"(?i)\b{m}\s*=\s*([a-z]+)", 1))
    signed = F.lower(F.regexp_extract(raw, r"(?i)\bdkim=[a-z]+[^;]*?\bheader\.(?:i|d)=@?([A-Za-z0-9.-]+)", 1))
    own = F.regexp_replace(F.lower(F.trim(F.substring_index(from_, "@", -1))), r"[>\s]+$", "")
    under = lambda a, b: (a == b) | F.endswith(a, F.concat(F.lit("."), b))
    apart = (own != "") & (signed != "") & ~under(signed, own) & ~under(own, signed)
    both = (verdict("spf") == "pass") & (verdict("dkim") == "pass")
    reason = (
        F.when(raw.isNull() | (raw == ""), "dmarc_pass" if allow_unauthenticated else "no_auth_header")
        .when(~server.isin(*(t.lower() for t in trusted)), "untrusted_authserv")
        .when(verdict("dmarc") == "fail", "dmarc_failed")
        .when(verdict("dmarc") == "pass", "dmarc_pass")
        .when(both & apart, "dkim_domain_mismatch")
        .when(both, "spf_and_dkim_pass")
        .otherwise("no_passing_mechanism")
    )
    return F.struct(reason.isin("dmarc_pass", "spf_and_dkim_pass").alias("trusted"), reason.alias("reason"))


class Routed(NamedTuple):
    outcomes: DataFrame
    facts: DataFrame


def _found(pattern: Column, group: Column | int = 1) -> Column:
    body = F.col("body")
    return F.when(F.rlike(body, pattern), F.call_function("regexp_extract", body, pattern, F.lit(group) if isinstance(group, int) else group))


def _read() -> Column:
    """What the matching template's patterns find in the body, as text, and the first required field that they don't find."""
    t = F.col("template")
    texts = {name: _found(t["fields"][name]["pattern"], t["fields"][name]["grp"]) for name in (*AMOUNTS, *DAYS, *WORDS)}
    return F.struct(*(c.alias(name) for name, c in texts.items()), F.coalesce(_found(t["credit"], 0).isNotNull(), F.lit(False)).alias("credited"), find_last4(F.col("body")).alias("last4"))


def _parsed() -> Column:
    """Amounts and dates of what was read; the token's currency, if one was read, is the amount's."""
    r, t = F.col("read"), F.col("template")
    currency = F.when(t["fields"]["token"].isNotNull(), as_map(CURRENCIES)[F.lower(r["token"])]).otherwise(t["currency"])
    currencies = F.array(*([currency] * 2), t["currency"], *([currency] * 2))
    days = F.transform(F.array(*(r[d] for d in DAYS)), lambda d: F.when(d.isNotNull(), parse_slash_date(d, t["order"])))
    return F.struct(currency.alias("currency"), parse_amounts(F.array(*(r[a] for a in AMOUNTS)), currencies).alias("amounts"), days.alias("days"))


def _fact() -> Column:
    """The fact of what was read and parsed, with the name of the first field that is missing or cannot be read."""
    t, r, p = F.col("template"), F.col("read"), F.col("parsed")
    amount = {name: F.get(p["amounts"], i) for i, name in enumerate(AMOUNTS)}
    day = {name: F.get(p["days"], i) for i, name in enumerate(DAYS)}
    texts = F.create_map(*(x for name in (*AMOUNTS, *DAYS, *WORDS) for x in (F.lit(name), r[name])))
    missing = F.get(F.filter(t["required"], lambda name: texts[name].isNull()), 0)
    bad = F.coalesce(
        F.when(p["currency"].isNull(), "unknown_currency"), F.when(amount["amount"]["error"].isNotNull(), F.concat(F.lit("amount:"), amount["amount"]["error"])),
        *(F.when(amount[name]["error"].isNotNull(), name) for name in AMOUNTS[1:]), *(F.when(r[name].isNotNull() & day[name].isNull(), f"date:{name}") for name in DAYS),
    )
    dated = t["kind"].isin("transaction", "payment", "balance")
    stated = t["fields"]["posted"].isNotNull()
    incoming = r["credited"] | F.coalesce(t["direction"].isin("credit", "inbound"), F.lit(False))
    direction = F.when(t["kind"] == "transaction", F.when(incoming, "credit").otherwise("debit")).when(t["kind"] == "payment", F.when(incoming, "inbound").otherwise("outbound"))
    minor = {name: amount[name]["minor"].alias(f"{name}_minor") for name in AMOUNTS}
    return F.struct(
        t["id"].alias("parser_id"), t["version"].alias("parser_version"), t["kind"].alias("kind"), t["account_kind"].alias("account_kind"), t["currency"].alias("account_currency"), r["last4"].alias("last4"), minor["amount"], p["currency"].alias("currency"),
        minor["minimum"], F.when(stated, day["posted"]).when(dated, utc_date(F.col("received_at"))).alias("posted_at"), F.when(dated, F.when(stated, "message").otherwise("received_at")).alias("posted_at_source"), day["due"].alias("due_date"), day["start"].alias("period_start"), day["end"].alias("period_end"),
        r["merchant"].alias("descriptor_raw"), t["confidence"].alias("confidence"), direction.alias("direction"), minor["original"], minor["previous"], minor["refund"], day["effective"].alias("effective_on"), t["labels"].alias("labels"), F.coalesce(F.concat(F.lit("field_not_found:"), missing), bad).alias("error"),
    )


def invalid(fact: Column, columns: list[str] | None = None) -> Column:
    """Names of the structural rules that a fact breaks; rules of columns that a table lacks are left out."""
    of = lambda name: fact[name]
    there = lambda *names: columns is None or all(n in columns for n in names)
    found = [F.when(~of("confidence").between(0, 1) | F.isnan("confidence") if columns is not None else ~of("confidence").between(0, 1), "confidence")] if there("confidence") else []
    found += [F.when(of("last4").isNotNull() & ~of("last4").rlike(r"^\d{4}$"), "last4")] if there("last4") else []
    found += [F.when(~of("message_id").eqNullSafe(of("source_message_id")), "message_id")] if columns is not None and there("message_id", "source_message_id") else []
    found += [F.when(of("period_start") > of("period_end"), "period_order")] if there("period_start", "period_end") else []
    for name, kind in KINDS.items():
        here = of("kind") == name
        found += [F.when(here & of(c).isNull(), f"missing:{kind.columns[c]}") for c in kind.required if there(c)]
        found += [F.when(here & (of(c) < 0), f"negative:{kind.columns[c]}") for c in kind.unsigned if there(c)]
        found += [F.when(here & (of(c) == ""), f"empty:{kind.columns[c]}") for c in kind.not_empty if there(c)]
        if kind.some_of and there(*kind.some_of):
            found.append(F.when(here & F.coalesce(*(of(c).cast("string") for c in kind.some_of)).isNull(), "nothing_extracted"))
    found.append(F.when(~of("kind").isin(*KINDS), "unknown_kind"))
    return F.array_compact(F.array(*found))


def facts_of(facts: DataFrame, kind: str) -> DataFrame:
    """The facts of one kind under that kind's own names and types."""
    spec = KINDS[kind]
    own = [c for c in ("message_id", "account_id", "institution", "region", "account_currency", "last4", "ordinal", "parser_id", "confidence") if c in facts.columns]
    return facts.where(F.col("kind") == kind).select(*own, *(F.col(c).alias(name) for c, name in spec.columns.items()), *(F.col("labels")[name].cast(kind_).alias(name) for name, kind_ in spec.labels.items()))


def routed_rows(messages: DataFrame, rules: DataFrame, templates: list[Template] | None = None, authenticity: bool = True) -> DataFrame:
    """One row per message with its outcome and, where it was parsed, its fact: what ``route_messages`` splits."""
    known = template_rules(messages.sparkSession, TEMPLATES if templates is None else templates)
    # a small file may hold many messages, and reading one is dear
    rows = classify_senders(messages.repartition("uid"), rules).join(known, "domain", "left").withColumn("auth", assess_authenticity(F.col("headers"), F.col("address")))
    believed = F.col("auth.trusted") if authenticity else F.lit(True)
    # exploding an array of one keeps the optimizer from writing an expression into each of its many uses
    once = lambda c: F.explode(F.array(c))
    rows = rows.withColumn("body", once(F.when(believed & F.col("sender_reason").isNull() & F.col("candidates").isNotNull(), message_text(F.col("subject"), F.col("text"), F.col("html")))))
    matching = F.filter("candidates", lambda t: F.forall(t["match"], lambda p: F.rlike(F.col("body"), p)))
    rows = rows.withColumn("hits", once(F.when(F.col("body").isNotNull(), matching))).withColumn("n_hits", F.coalesce(F.array_size("hits"), F.lit(0)))
    # texts are read by the one template that matched, and only then parsed
    rows = rows.withColumn("template", F.when(F.col("n_hits") == 1, F.get("hits", 0)))
    for name, step in (("read", _read()), ("parsed", _parsed()), ("fact", _fact())):
        rows = rows.withColumn(name, once(F.when(F.col("template").isNotNull(), step)))
    rows = rows.withColumn("broken", F.when(F.col("fact.error").isNull(), invalid(F.col("fact"))))
    reason = F.when(F.col("sender_reason").isNotNull(), "ignored")
    if authenticity:
        reason = F.when(~F.col("auth.trusted"), "failed_authenticity").otherwise(reason)
    reason = (
        F.when(reason.isNotNull(), reason).when(F.col("n_hits") == 0, "no_parser_matched").when(F.col("n_hits") > 1, "multiple_parsers_matched")
        .when(F.col("fact.error").isNotNull(), "parser_extract_threw").when(F.size("broken") > 0, "invalid_fact")
    )
    rows = rows.withColumn("why", reason)
    status = F.when(F.col("why") == "ignored", "ignored").when(F.col("why").isNotNull(), "quarantined").otherwise("parsed")
    detail = F.when(F.col("why") == "failed_authenticity", F.col("auth.reason")).when(F.col("why") == "ignored", F.col("sender_reason")).when(F.col("why") == "parser_extract_threw", F.col("fact.error")).when(F.col("why") == "invalid_fact", F.array_join("broken", ","))
    done = F.col("why").isNull()
    return rows.select(
        "uid", "message_id", "received_at", "institution", "region", status.alias("status"), F.when(F.col("why") != "ignored", F.col("why")).alias("reason"), detail.alias("detail"), F.when(done, F.col("fact.parser_id")).alias("parser_id"),
        F.when(done, F.col("fact.parser_version")).alias("parser_version"), F.when(done, 1).otherwise(0).alias("n_facts"), F.when(done, F.col("fact").dropFields("error")).alias("fact"),
    )


def split_routed(rows: DataFrame) -> Routed:
    """Outcomes and facts of routed rows."""
    outcomes = rows.select("uid", "message_id", "received_at", "status", "reason", "detail", "parser_id", "parser_version", "n_facts")
    return Routed(outcomes, rows.where("status = 'parsed'").select("uid", "message_id", "received_at", "institution", "region", F.lit(0).alias("ordinal"), "fact.*"))


def route_messages(messages: DataFrame, rules: DataFrame, templates: list[Template] | None = None, authenticity: bool = True) -> Routed:
    """One outcome per message: ignored, quarantined with a reason, or parsed; and the parsed messages' facts.

    messages: uid, message_id, from_header, subject, received_at, text, html, headers. Reasons: failed_authenticity,
    no_parser_matched, multiple_parsers_matched, parser_extract_threw, invalid_fact. Mail from senders that are not on
    the list, or whose header cannot be read, is ignored; the detail says which. ``STORED_REASONS`` has the reasons
    under which failures are stored. Templates are rows that meet the messages of their domain, so the plan and its
    generated code stay the same however many there are, and a message is held against its own sender's only.
    """
    return split_routed(routed_rows(messages, rules, templates, authenticity))


def parse_failures(outcomes: DataFrame) -> DataFrame:
    """message_id, parser_id, reason (as stored) and detail of quarantined messages."""
    return outcomes.where("status = 'quarantined'").select("message_id", "parser_id", F.coalesce(as_map(STORED_REASONS)[F.col("reason")], F.lit("extract_threw")).alias("reason"), "detail")


def validate_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts that keep to the rules of their kind, and the others with the rules that they break."""
    judged = facts.withColumn("broken", invalid(F.struct(*(F.col(c) for c in facts.columns)), facts.columns))
    return judged.where(F.size("broken") == 0).drop("broken"), judged.where(F.size("broken") > 0)


def resolve_accounts(facts: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with account_id, and the accounts that they make.

    Active accounts (account_id, institution, currency, kind, last4, display_name, is_active) match by institution and
    currency (and owner_id, where both tables have it), best with equal last4, then kind, then any, by display name. A null
    owner, institution or currency equals null, so every fact gets an account. A pair of institution and currency without
    any account makes one, from its earliest fact (uid, ordinal); its id hashes that fact's message.
    """
    owner = [c for c in ("owner_id",) if c in facts.columns and c in accounts.columns]
    pair = [*owner, "institution", "account_currency"]
    keys = [f"__{c}" for c in pair]
    keyed = lambda df: df.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(keys, pair, strict=True)})
    a = keyed(accounts.where("is_active").select(*owner, "institution", F.col("currency").alias("account_currency"), "account_id", F.col("kind").alias("a_kind"), F.col("last4").alias("a_last4"), "display_name"))
    made = F.struct(
        F.concat_ws(":", *pair, F.coalesce("last4", F.substring(F.sha2("message_id", 256), 1, 12))).alias("account_id"),
        F.coalesce("account_kind", F.lit("checking")).alias("a_kind"), F.col("last4").alias("a_last4"), F.col("institution").alias("display_name"), *(F.col(c).alias(c) for c in pair),
    )
    found = keyed(facts)
    fresh = found.join(a.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.min_by(made, F.struct("uid", "ordinal")).alias("made")).select(*keys, "made.*")
    known = a.select(*keys, "account_id", "a_kind", "a_last4", "display_name").unionByName(fresh.select(*keys, "account_id", "a_kind", "a_last4", "display_name"))
    # one account for each way to match, so that a fact meets three rows at most
    for name, more in (("by_last4", {"a_last4": "last4"}), ("by_kind", {"a_kind": "account_kind"}), ("by_pair", {})):
        best = known.dropna(subset=list(more)).groupBy(*keys, *more).agg(F.min_by("account_id", F.struct("display_name", "account_id")).alias(name))
        found = found.join(best.withColumnsRenamed(more), [*keys, *more.values()], "left")
    ways = ["by_last4", "by_kind", "by_pair"]
    found = found.withColumn("account_id", F.coalesce(*ways)).drop(*ways, *keys)
    new = fresh.select("account_id", *owner, "institution", F.col("account_currency").alias("currency"), F.col("a_kind").alias("kind"), F.col("a_last4").alias("last4"), "display_name", F.lit(True).alias("is_active"))
    return found, new


def ledger_rows(facts: DataFrame) -> DataFrame:
    """Ledger rows of transactions and payments: debits and outbound payments are negative; without a name, Unknown and Payment."""
    rows = facts.where("kind IN ('transaction', 'payment')")
    leaves = F.coalesce(F.col("direction").isin("debit", "outbound"), F.lit(True)) if "direction" in facts.columns else F.lit(True)
    return rows.select(
        dedupe_key(F.lit("alert"), F.col("message_id"), F.col("ordinal")).alias("dedupe_key"), "account_id", "posted_at", F.when(leaves, -F.col("amount_minor")).otherwise(F.col("amount_minor")).alias("amount_minor"), "currency",
        F.coalesce("descriptor_raw", F.when(F.col("kind") == "payment", "Payment").otherwise("Unknown")).alias("descriptor_raw"), "region", F.lit("alert").alias("source"), F.col("message_id").alias("source_ref"), "ordinal", F.lit(None).cast("string").alias("superseded_by"),
    )


def balance_rows(facts: DataFrame) -> DataFrame:
    """Balance observations of facts."""
    return facts_of(facts, "balance").select("account_id", "currency", F.col("amount_minor").alias("balance_minor"), F.col("observed_at").alias("observed_on"), "balance_type", F.col("message_id").alias("source_ref"))


def statement_rows(facts: DataFrame, as_of) -> DataFrame:
    """Statements of facts; a period that is not stated is the parameter's day. The id is the account's and the period's end, or else the message's, so that reading a message again on another day makes no other statement."""
    day = F.lit(as_of).cast("date")
    statement_id = F.concat_ws("-", F.lit("stmt"), "account_id", F.coalesce(F.col("period_end").cast("string"), "message_id"))
    return facts.where("kind = 'statement'").select("account_id", F.coalesce("period_start", "period_end", day).alias("period_start"), F.coalesce("period_end", day).alias("period_end"), F.coalesce("amount_minor", F.lit(0)).alias("balance_minor"), F.col("minimum_minor").alias("minimum_due_minor"), "due_date", "currency", statement_id.alias("statement_id"))


def needs_reparse(stored: DataFrame, versions: DataFrame) -> DataFrame:
    """Stored messages without a parser, or whose parser (parser_id, version) has moved on."""
    both = stored.join(versions, "parser_id", "left")
    return both.where("parser_id IS NULL OR parser_version < version").drop("version")


def sync_counters(outcomes: DataFrame) -> DataFrame:
    """Fetched, parsed, ignored, quarantined, facts (where outcomes count them: n_facts) and the highest uid, in one row."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    facts = [F.coalesce(F.sum("n_facts"), F.lit(0)).alias("facts")] if "n_facts" in outcomes.columns else []
    return outcomes.agg(*facts, F.count(F.lit(1)).alias("fetched"), n("parsed"), n("ignored"), n("quarantined"), F.max("uid").alias("highest_uid"))
