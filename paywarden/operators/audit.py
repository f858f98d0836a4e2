"""Audit log: chained writing, chain checks, compliance report, metrics."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crypto
from .folds import ordered_fold

FIELDS = ("timestamp", "event_type", "resource_url", "amount_usd", "network", "agent_id", "outcome", "pii_entities_found", "policy_limit_usd", "replay_fingerprint", "error_message")
# fixed values: upper ends of the amount histogram's buckets
BUCKETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 50.0)


def line_of(event: dict, prev: str | None) -> str:
    """A log line: JSON with a space after separators, ASCII only, the link to the entry before it last."""
    return json.dumps({**event, "prev_entry_hmac": prev})


def chain_step(prev: str | None, text: str | None, key: bytes) -> tuple[str | None, list[str | None]]:
    """(the line, [the link of the next one]) of an event given as a JSON object; what is none has no line and leaves the chain as it is."""
    try:
        event = json.loads(text) if text is not None else None
    except ValueError:
        event = None
    if not isinstance(event, dict):
        return None, [prev]
    raw = line_of(event, prev)
    return raw, [hmac.new(key, raw.encode(), hashlib.sha256).hexdigest()]


def chain(events: DataFrame, key: bytes, log: str = "agent_id", seq: str = "seq", body: str = "body") -> DataFrame:
    """events with prev_entry_hmac and raw (the line); body is the event as a JSON object, chained for each log by seq.

    A body that is null or no JSON object has no line: both columns are null and the chain goes on without it.
    """

    def step(state: list, text: str | None) -> tuple[str | None, str | None]:
        prev = state[0] if state else None
        raw, state[:] = chain_step(prev, text, key)
        return (prev, raw) if raw is not None else (None, None)

    return ordered_fold(events, log, [seq], [body], list, step, "prev_entry_hmac string, raw string")


def check_chain(lines: DataFrame, key: bytes, log: str = "agent_id", seq: str = "seq", raw: str = "raw", segmented: bool = False) -> DataFrame:
    """lines with chain_ok: the link equals the HMAC of the line before; the first has none.

    A log's lines are sorted in one task, which holds one line and the one before. With `segmented`, a null link also
    starts a new session.
    """
    w = Window.partitionBy(log).orderBy(seq)
    link = F.get_json_object(raw, "$.prev_entry_hmac")
    before = F.lag(crypto.hmac_sha256(F.col(raw), key)).over(w)
    fine = link.eqNullSafe(before)
    return lines.withColumn("chain_ok", fine | link.isNull() if segmented else fine)


def agent_summaries(audit: DataFrame) -> DataFrame:
    """A row per agent (null is one): counts of the six event types and the dollars of allowed payments."""
    n = lambda t, a: F.count_if(F.col("event_type") == t).alias(a)
    return audit.groupBy("agent_id").agg(
        n("PAYMENT_ALLOWED", "allowed"), n("PII_REDACTED", "pii_redacted"), n("PII_BLOCKED", "pii_blocked"), n("POLICY_BLOCKED", "policy_blocked"),
        n("REPLAY_BLOCKED", "replay_blocked"), n("PAYMENT_ERROR", "errors"), F.coalesce(F.sum(F.when(F.col("event_type") == "PAYMENT_ALLOWED", F.coalesce("amount_usd", F.lit(0.0)))), F.lit(0.0)).alias("total_usd"),
    )


def entity_counts(audit: DataFrame) -> DataFrame:
    return audit.select(F.explode("pii_entities_found").alias("entity_type")).groupBy("entity_type").agg(F.count("*").alias("n"))


def totals(audit: DataFrame) -> DataFrame:
    spend = F.sum(F.when(F.col("event_type") == "PAYMENT_ALLOWED", F.col("amount_usd")))
    return audit.agg(F.count("*").alias("events"), F.count_if(F.col("outcome") == "blocked").alias("blocked"), F.count_if(F.col("outcome") == "allowed").alias("allowed"), F.round(F.coalesce(spend, F.lit(0.0)), 6).alias("total_spend_usd"))


def entries_for_agent(audit: DataFrame, agent_id: str) -> DataFrame:
    return audit.where(F.col("agent_id") == agent_id)


def write_report(audit: DataFrame, folder: str) -> None:
    """The compliance report as JSON tables totals, agents and entities in a folder, written by the executors."""
    for name, df in (("totals", totals(audit)), ("agents", agent_summaries(audit)), ("entities", entity_counts(audit))):
        df.write.mode("overwrite").json(f"{folder}/{name}")


def report(audit: DataFrame, chain_ok: bool = True, warnings: tuple[str, ...] = ()) -> dict:
    """The compliance report as a dict: totals, a row per agent by spend, entity counts by number.

    It has every agent and is made on the driver, for logs of so many agents as fit there; write_report has no such bound.
    """
    t = totals(audit).first().asDict()
    agents = [r.asDict() for r in agent_summaries(audit).orderBy(F.desc("total_usd"), "agent_id").collect()]
    entities = {r[0]: r[1] for r in entity_counts(audit).orderBy(F.desc("n"), "entity_type").collect()}
    return {**t, "chain_ok": chain_ok, "chain_warnings": list(warnings), "agents": agents, "pii_entities": entities}


def summary(rep: dict) -> str:
    """The report as text."""
    rows = [f"events {rep['events']}  allowed {rep['allowed']}  blocked {rep['blocked']}  spend {rep['total_spend_usd']:.6f} USD", f"chain {'intact' if rep['chain_ok'] else 'BROKEN'}"]
    rows += [f"warning: {w}" for w in rep["chain_warnings"]]
    rows += [f"agent {a['agent_id']}: {a['total_usd']:.6f} USD, {a['allowed']} allowed" for a in rep["agents"]]
    return "\n".join(rows + [f"{k}: {v}" for k, v in rep["pii_entities"].items()])


#: Help texts of the metrics, which are counters but for the histogram of amounts.
METRICS = {
    "payments_total": "Payment attempts by outcome and reason", "pii_detections_total": "Personal data found by type and action", "policy_violations_total": "Payments over a limit by limit",
    "replay_detections_total": "Payments seen before", "mpa_events_total": "Multi-party approvals by outcome", "payment_amount_usd": "Amounts of payments in dollars",
}
LABELS = {"payments_total": ("outcome", "reason"), "pii_detections_total": ("entity_type", "action"), "policy_violations_total": ("violation_type",), "replay_detections_total": (), "mpa_events_total": ("outcome",)}


def counters(audit: DataFrame, reason: Column, violation: Column | None = None, mpa: Column | None = None, action: Column | None = None) -> DataFrame:
    """All labelled counters in one pass: (metric, label_a, label_b, n).

    violation: the limit that a POLICY_BLOCKED event hit; mpa: approved, denied or timeout, null where no approval was
    asked; action: what is done about personal data, by default block for PII_BLOCKED events and redact for others.
    """
    pay = F.struct(F.lit("payments_total").alias("metric"), F.col("outcome").alias("label_a"), reason.alias("label_b"))
    some = lambda cond, metric, a, b: F.when(cond, F.struct(F.lit(metric).alias("metric"), a.alias("label_a"), b.alias("label_b")))
    none = F.lit("").alias("x")
    hit = violation if violation is not None else F.lit("limit_exceeded")
    parts = [pay, some(F.col("event_type") == "POLICY_BLOCKED", "policy_violations_total", hit, none), some(F.col("event_type") == "REPLAY_BLOCKED", "replay_detections_total", none, none)]
    if mpa is not None:
        parts.append(some(mpa.isNotNull(), "mpa_events_total", mpa, none))
    action = action if action is not None else F.when(F.col("event_type") == "PII_BLOCKED", "block").otherwise("redact")
    found = F.transform(F.coalesce("pii_entities_found", F.array().cast("array<string>")), lambda t: F.struct(F.lit("pii_detections_total").alias("metric"), t.alias("label_a"), action.alias("label_b")))
    one = audit.select(F.explode(F.concat(F.filter(F.array(*parts), lambda x: x.isNotNull()), found)).alias("c")).select("c.*")
    return one.groupBy("metric", "label_a", "label_b").agg(F.count("*").alias("n"))


def histogram(amounts: DataFrame, column: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative buckets (le, n, total), with +Inf, whose n is the count of all and whose total is their sum; one aggregate row spread over rows."""
    edges = [*buckets, float("inf")]
    row = amounts.where(F.col(column).isNotNull()).agg(*[F.count_if(F.col(column) <= e).alias(f"b{i}") for i, e in enumerate(edges)], F.sum(column).alias("total"))
    cells = F.array(*[F.struct(F.lit("+Inf" if e == float("inf") else str(e)).alias("le"), F.col(f"b{i}").alias("n"), F.when(F.lit(e == float("inf")), F.coalesce("total", F.lit(0.0))).alias("total")) for i, e in enumerate(edges)])
    return row.select(F.inline(cells))


def exposition(counts: DataFrame, amounts: DataFrame, namespace: str = "paywarden") -> DataFrame:
    """Text lines (no, line) of the counters and the histogram as scrapers read them, in order of no; label values are escaped."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    label = F.lit(None).cast("string")
    for name, labels in LABELS.items():
        pairs = [F.concat(F.lit(f"{x}="), quoted(F.coalesce(c, F.lit("")))) for x, c in zip(labels, (F.col("label_a"), F.col("label_b")))]
        label = F.when(F.col("metric") == name, F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if pairs else F.lit("")).otherwise(label)
    lines = counts.select("metric", F.concat(F.lit(f"{namespace}_"), "metric", label, F.lit(" "), F.col("n").cast("string")).alias("line"), F.lit(1.0).alias("at"))
    at = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").try_cast("double"))
    h = amounts.select(F.lit("payment_amount_usd").alias("metric"), F.concat(F.lit(f'{namespace}_payment_amount_usd_bucket{{le="'), "le", F.lit('"} '), F.col("n").cast("string")).alias("line"), at.alias("at"))
    ends = amounts.where("le = '+Inf'").select(F.lit("payment_amount_usd").alias("metric"), F.inline(F.array(*[F.struct(F.concat(F.lit(f"{namespace}_payment_amount_usd_{x} "), v.cast("string")).alias("line"), F.lit(float("nan")).alias("at")) for x, v in (("sum", F.col("total")), ("count", F.col("n")))])))
    heads = [(m, f"# {k} {namespace}_{m} {v}", -2.0 + i) for m, t in METRICS.items() for i, (k, v) in enumerate((("HELP", t), ("TYPE", "histogram" if m == "payment_amount_usd" else "counter")))]
    out = lines.unionByName(h).unionByName(ends).unionByName(counts.sparkSession.createDataFrame(heads, "metric string, line string, at double"))
    return out.select(F.row_number().over(Window.orderBy("metric", "at", "line")).cast("long").alias("no"), "line")  # as many rows as there are label values
