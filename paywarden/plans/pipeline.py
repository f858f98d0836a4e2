"""The decision pipeline: amounts, personal data, wallets, limits, replays and approvals, in that order.

Two shuffles carry state (by agent, then by fingerprint), one brings approvals; a later rejection does not give back what
an earlier step recorded, so the steps need no shared state. Stopped payments go along to the end, so every step is
planned and run once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto, scalars
from ..functions.detect import STABLE, entities_of, normalise, redact, scan_fields
from ..functions.json_scan import scan_json
from ..operators import audit
from ..operators.admission import Policy, budget_decisions, is_small, quorum, replay_decisions, wallet_check

VERDICTS = ("payment_error", "pii_blocked", "wallet_blocked", "policy_blocked", "replay_blocked", "mpa_blocked", "mpa_timeout", "allowed")
FIELDS = ("resource_url", "description", "reason")
ACTIONS = ("redact", "block", "warn")


def screen(payments: DataFrame, detector: str = "patterns", min_score: float = 0.0) -> DataFrame:
    """payments with pii_entities (types in order of url, description, reason, extra; as often as found), pii_types, and clean_* of the four fields.

    A missing field counts as null. Texts are normalised (NFKC and folding) before they are searched; a clean_* field is
    as given where the payment has no entity at all.
    """
    has = [f for f in FIELDS if f in payments.columns]
    df = payments.withColumns({f"__n_{f}": normalise(F.col(f)) for f in has})
    df = df.withColumn("__found", scan_fields({f: F.col(f"__n_{f}") for f in has}, detector, min_score))
    types = F.transform("__found", lambda e: e["entity_type"])
    if "extra" in payments.columns:
        # every pattern needs an @ or four digits; escapes and characters that NFKC may change could hide them
        plain = ~F.coalesce(F.col("extra").rlike(r"@|\\|(?:[0-9][^0-9]*){4}") | ~F.col("extra").rlike(STABLE), F.lit(False)) & F.lit(detector == "patterns")
        df = df.withColumn("__extra", scan_json(F.when(~plain, F.col("extra"))))
        types = F.concat(types, F.when(~plain, F.coalesce("__extra.entity_types", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("pii_entities", types).withColumn("pii_types", F.array_sort(F.array_distinct("pii_entities")))
    some = F.size("pii_entities") > 0
    clean = {f"clean_{f}": F.when(some, redact(F.col(f"__n_{f}"), entities_of(F.col("__found"), f))).otherwise(F.col(f)) for f in has}
    if "extra" in payments.columns:
        clean["clean_extra"] = F.when(F.size("__extra.entity_types") > 0, F.col("__extra.clean")).otherwise(F.col("extra"))
    return df.withColumns(clean).drop("__found", "__extra", *[f"__n_{f}" for f in has])


def decide(
    payments: DataFrame, policy: Policy, trusted: DataFrame, key: bytes, approvals: DataFrame, approvers: DataFrame, threshold: int = 2, min_amount_usd: float = 0.0,
    pii_action: str = "redact", ttl_seconds: int = 300, detector: str = "patterns", min_score: float = 0.0, timeout_seconds: float | None = None,
) -> DataFrame:
    """payments with screen's columns, verdict, error and the columns of each step (null where a step was not reached).

    amount and currency are as the payment's header has them; amount_usd is made from them. A payment with a bad amount,
    currency or time ends as payment_error, with `error` saying why, before any step records it. With pii_action redact
    the later steps see the clean fields (replays are told by the original url), with warn and block the given ones.
    """
    if pii_action not in ACTIONS:
        raise ValueError(f"pii_action is one of {', '.join(ACTIONS)}")
    bad = F.coalesce(scalars.amount_error(F.col("amount"), F.col("currency")), F.when(F.col("ts").isNull(), F.lit("invalid_time")))
    rows = payments.withColumns({"error": bad, "amount_usd": scalars.amount_usd(F.col("amount"), F.col("currency"))})
    url = F.col("clean_resource_url") if pii_action == "redact" else F.col("resource_url")
    screened = lambda rows: screen(rows, detector, min_score).withColumn("__url", url)
    few = is_small(trusted)  # then wallets are told without moving payments, which go to their agent's partition before they grow
    df = screened(rows.repartition(F.col("agent_id")) if few else rows)
    requests = screened(rows).select("payment_id", "ts", "amount_usd", "network", "agent_id", "__url")  # approvals meet these, not what the folds make of them
    stop = (F.size("pii_types") > 0) if pii_action == "block" else F.lit(False)
    df = wallet_check(df.withColumn("__pii", stop), trusted, url="__url")
    early = F.when(F.col("error").isNotNull(), "payment_error").when(F.col("__pii"), "pii_blocked").when(~F.col("wallet_ok"), "wallet_blocked")
    alive = F.col("verdict").isNull()
    df = budget_decisions(df.withColumn("verdict", early), policy, url="__url", alive=alive, dealt=few)
    df = df.withColumn("verdict", F.coalesce("verdict", F.when(F.col("policy_verdict") != "allowed", "policy_blocked")))
    mark = crypto.fingerprint(F.col("resource_url"), F.col("pay_to"), F.col("amount"), F.col("currency"), F.col("deadline_seconds"), key)
    df = replay_decisions(df.withColumn("replay_fingerprint", mark), ttl_seconds, alive=alive)
    df = df.withColumn("verdict", F.coalesce("verdict", F.when(~F.col("replay_ok"), "replay_blocked"))).withColumn("__alive", alive)
    if approvers.isEmpty() and threshold <= 0:  # no approvals are asked for
        df = df.withColumns({"approvals_received": F.lit(None).cast("long"), "mpa_verdict": F.lit(None).cast("string")})
    else:
        signed = crypto.canonical_approval(F.col("__url"), F.col("amount_usd"), F.col("network"), F.col("agent_id"), ascii_only=False)
        df = quorum(df, approvals, approvers, threshold, min_amount_usd, signed, timeout_seconds, "__alive", requests)
    last = F.when(F.col("mpa_verdict") == "denied", "mpa_blocked").when(F.col("mpa_verdict") == "timeout", "mpa_timeout").otherwise("allowed")
    return df.withColumn("verdict", F.coalesce("verdict", last)).drop("__pii", "__url", "__alive")


#: Audit event and error text of each verdict; an allowed payment has no error.
EVENTS = {
    "payment_error": ("PAYMENT_ERROR", "payment cannot be read"), "pii_blocked": ("PII_BLOCKED", "personal data in payment metadata"), "wallet_blocked": ("WALLET_BLOCKED", "wallet not listed for origin"),
    "policy_blocked": ("POLICY_BLOCKED", "limit exceeded"), "replay_blocked": ("REPLAY_BLOCKED", "seen before"), "mpa_blocked": ("MPA_BLOCKED", "approvals refused"),
    "mpa_timeout": ("MPA_BLOCKED", "approvals not in time"), "allowed": ("PAYMENT_ALLOWED", None),
}


def _of_verdict(i: int) -> Column:
    out = F.lit(None).cast("string")
    for v, pair in EVENTS.items():
        out = F.when(F.col("verdict") == v, F.lit(pair[i]).cast("string")).otherwise(out)
    return out


def audit_events(decisions: DataFrame, pii_action: str = "redact") -> DataFrame:
    """Audit rows of decisions: PII_REDACTED (with pii_action redact) and the final event, so a redacted and paid payment has two.

    n tells a payment's events apart, in order. The PII event names all entities found; a limit, a fingerprint's first 16
    characters and an error text come with the events that they belong to.
    """
    at = lambda verdict, c: F.when(F.col("verdict") == verdict, c)
    none = F.array().cast("array<string>")
    text = F.when(F.col("error").isNotNull(), F.concat(_of_verdict(1), F.lit(": "), F.col("error"))).otherwise(_of_verdict(1))
    final = F.struct(
        _of_verdict(0).alias("event_type"), F.when(F.col("verdict") == "allowed", "allowed").otherwise("blocked").alias("outcome"), F.coalesce(at("pii_blocked", F.col("pii_entities")), none).alias("pii_entities_found"),
        at("policy_blocked", F.col("policy_limit_usd")).alias("policy_limit_usd"), at("replay_blocked", crypto.short_id(F.col("replay_fingerprint"))).alias("replay_fingerprint"), scalars.safe_message(text).alias("error_message"),
    )
    null = lambda kind: F.lit(None).cast(kind)
    red = F.struct(F.lit("PII_REDACTED").alias("event_type"), F.lit("allowed").alias("outcome"), F.col("pii_entities").alias("pii_entities_found"), null("double").alias("policy_limit_usd"), null("string").alias("replay_fingerprint"), null("string").alias("error_message"))
    both = F.when((F.size("pii_entities") > 0) & (F.col("verdict") != "payment_error"), F.array(red, final)).otherwise(F.array(final)) if pii_action == "redact" else F.array(final)
    head = decisions.select("*", F.posexplode(both).alias("n", "__e"))
    return head.select("payment_id", "agent_id", F.col("ts").alias("timestamp"), "seq", "n", "amount_usd", "network", F.col("clean_resource_url").alias("resource_url"), "__e.*")


def metrics(decisions: DataFrame, pii_action: str = "redact") -> DataFrame:
    """The labelled counters of decisions, in one pass."""
    event = _of_verdict(0)
    reason = F.when(event == "PAYMENT_ALLOWED", "none").when(event == "PAYMENT_ERROR", "error").otherwise(F.lower(F.regexp_replace(event, "_BLOCKED$", "")))
    rows = decisions.select(
        event.alias("event_type"), F.when(F.col("verdict") == "allowed", "allowed").otherwise("blocked").alias("outcome"), reason.alias("reason"), "policy_verdict",
        F.when(F.col("mpa_verdict") != "exempt", F.col("mpa_verdict")).alias("mpa"), F.when(F.col("verdict") != "payment_error", F.col("pii_entities")).alias("pii_entities_found"),
    )
    return audit.counters(rows, F.col("reason"), F.col("policy_verdict"), F.col("mpa"), F.lit(pii_action))
