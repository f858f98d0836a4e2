"""Spending limits, replay protection, wallets and quorum."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto, urls
from .folds import ordered_fold


@dataclass(frozen=True)
class Policy:
    """Limits in dollars; None means no limit. The window is in seconds, its lower end included."""

    max_per_call_usd: float | None = None
    daily_limit_usd: float | None = None
    per_endpoint: dict[str, float] = field(default_factory=dict)
    window_seconds: int = 86_400


EPS = 2.0**-52


class Ledger:
    """Amounts of the last window, oldest first, with a running total and a bound of its error.

    Whether a payment fits is what a left fold over the window in order of arrival says. The running total decides as
    long as the limit is farther away than its error and the fold's together; only then are the amounts folded anew.
    So a payment costs the same however many the window holds.
    """

    def __init__(self) -> None:
        self.rows: deque[tuple[int, float]] = deque()
        self.sum = self.error = 0.0

    def _move(self, by: float) -> None:
        self.sum += by
        self.error += EPS * (abs(self.sum) + abs(by))

    def record(self, now: int, amount: float) -> None:
        self.rows.append((now, amount))
        self._move(amount)

    def exceeds(self, now: int, window: int, amount: float, limit: float) -> bool:
        """Whether the window's total and this amount pass the limit."""
        while self.rows and self.rows[0][0] < now - window:
            self._move(-self.rows.popleft()[1])
        if not self.rows:
            self.sum = self.error = 0.0
        far = 2 * self.error + EPS * (len(self.rows) + 2) * (abs(self.sum) + self.error + amount)
        if abs(self.sum + amount - limit) > far:
            return self.sum + amount > limit
        total = 0.0  # a left fold in order of arrival
        for _, v in self.rows:
            total += v
        return total + amount > limit


def invalid(now: int | None, amount: float | None) -> str | None:
    """Why a payment cannot be decided: no time, or an amount that is null, not finite or negative; None if it can."""
    if now is None:
        return "invalid_time"
    return "invalid_amount" if amount is None or not math.isfinite(amount) or amount < 0 else None


class Budget:
    """State of one agent: a ledger over all payments and one for each endpoint."""

    def __init__(self, policy: Policy):
        self.policy, self.all, self.by = policy, Ledger(), {}

    def record(self, now: int, amount: float, endpoint: str | None) -> None:
        self.all.record(now, amount)
        if endpoint is not None:
            self.by.setdefault(endpoint, Ledger()).record(now, amount)

    def decide(self, now: int | None, amount: float | None, endpoint: str | None, alive: bool = True) -> tuple[str | None, float | None]:
        """(verdict, limit that was hit); only an allowed payment is recorded, in both ledgers. No verdict if it is not alive."""
        if not alive:
            return None, None
        if (bad := invalid(now, amount)) is not None:
            return bad, None
        p, window = self.policy, self.policy.window_seconds * 1_000_000
        if p.max_per_call_usd is not None and amount > p.max_per_call_usd:
            return "per_call", p.max_per_call_usd
        if p.daily_limit_usd is not None and self.all.exceeds(now, window, amount, p.daily_limit_usd):
            return "daily_limit", p.daily_limit_usd
        if endpoint is not None and self.by.setdefault(endpoint, Ledger()).exceeds(now, window, amount, p.per_endpoint[endpoint]):
            return "per_endpoint", p.per_endpoint[endpoint]
        self.record(now, amount, endpoint)
        return "allowed", None


def budget_decisions(payments: DataFrame, policy: Policy, agent: str = "agent_id", ts: str = "ts", seq: str = "seq", amount: str = "amount_usd", url: str = "resource_url", alive: Column | None = None, dealt: bool = False) -> DataFrame:
    """payments with policy_verdict and policy_limit_usd; decided greedily in order of (ts, seq) for each agent.

    alive: rows for which it is false get nulls and have no effect, as they were stopped before. dealt: see ordered_fold.

    An amount that is null, not finite or negative is `invalid_amount`, a null time `invalid_time`: not recorded, so
    it has no effect on other payments. One agent's payments are decided by one task, as each depends on those before.
    """
    df = payments.withColumns({"__at": F.unix_micros(F.col(ts).cast("timestamp")), "__endpoint": urls.longest_prefix(F.col(url), list(policy.per_endpoint)), "__usd": F.col(amount).cast("double"), "__alive": alive if alive is not None else F.lit(True)})
    out = ordered_fold(df, agent, ["__at", seq], ["__at", "__usd", "__endpoint", "__alive"], lambda: Budget(policy), Budget.decide, "policy_verdict string, policy_limit_usd double", dealt)
    return out.drop("__at", "__endpoint", "__usd", "__alive")


def replay_step(live: int | None, now: int | None, ttl: int) -> tuple[bool, int | None]:
    """(accepted, expiry from now on) of a fingerprint that expires at `live`; without a time nothing is accepted."""
    fine = now is not None and (live is None or live <= now)
    return fine, now + ttl if fine else live


def replay_decisions(payments: DataFrame, ttl_seconds: int = 300, key: str = "replay_fingerprint", ts: str = "ts", seq: str = "seq", alive: Column | None = None) -> DataFrame:
    """payments with replay_ok: a fingerprint is accepted if its last acceptance is at least the ttl ago; a null time is not.

    alive: rows for which it is false get null and have no effect.
    """
    df = payments.withColumns({"__at": F.unix_micros(F.col(ts).cast("timestamp")), "__alive": alive if alive is not None else F.lit(True)})
    ttl = ttl_seconds * 1_000_000

    def step(state: list, now: int | None, alive: bool) -> tuple[bool | None]:
        if not alive:
            return (None,)
        fine, live = replay_step(state[0] if state else None, now, ttl)
        state[:] = [live]
        return (fine,)

    return ordered_fold(df, key, ["__at", seq], ["__at", "__alive"], list, step, "replay_ok boolean").drop("__at", "__alive")


def rolling_spend(payments: DataFrame, window_seconds: int = 86_400, agent: str = "agent_id", ts: str = "ts", amount: str = "amount_usd") -> DataFrame:
    """payments with the sum over the last window, lower end included; observes, does not decide."""
    from pyspark.sql import Window

    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(agent).orderBy(at).rangeBetween(-window_seconds * 1_000_000, 0)
    return payments.withColumn("rolling_usd", F.sum(amount).over(w))


def wallet_check(payments: DataFrame, trusted: DataFrame, url: str = "resource_url", wallet: str = "pay_to") -> DataFrame:
    """payments with wallet_ok: false if the origin is listed and the wallet is not listed for it."""
    listed = trusted.select(F.rtrim(F.col("origin"), F.lit("/")).alias("__origin"), F.col("wallet").alias("__wallet"))
    origins = listed.select("__origin").distinct().withColumn("__listed", F.lit(True))
    pairs = listed.distinct().withColumn("__pair", F.lit(True))
    out = payments.withColumn("__origin", urls.origin(F.col(url)))
    out = out.join(small(origins), "__origin", "left").join(small(pairs), (out["__origin"] == pairs["__origin"]) & (F.col(wallet) == F.col("__wallet")), "left").drop(pairs["__origin"])
    return out.withColumn("wallet_ok", F.col("__listed").isNull() | F.coalesce("__pair", F.lit(False))).drop("__origin", "__listed", "__wallet", "__pair")


def is_small(df: DataFrame, most: int = 100_000) -> bool:
    """Whether df has at most `most` rows, as configuration tables do."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small; else as it is, to be joined by shuffles."""
    return F.broadcast(df) if is_small(df) else df


def valid_votes(approvals: DataFrame, approvers: DataFrame, body: str) -> DataFrame:
    """approvals of known approvers with mode and valid: the signature of `body` is right for the approver's secret
    (crypto), or the approval says approved (webhook). The padded secrets are made once per approver."""
    inner, outer = crypto.hmac_pads(F.col("shared_secret"))
    known = approvers.select("approver_id", "mode", inner.alias("__inner"), outer.alias("__outer"))
    given = approvals.join(small(known), "approver_id")
    signed = crypto.hmac_padded(F.col(body), F.col("__inner"), F.col("__outer")) == F.lower("signature")
    valid = F.when(F.col("mode") == "crypto", signed).otherwise(F.col("approved"))
    return given.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("__inner", "__outer")


def quorum_verdict(threshold: int, signed: Column, answered: Column, agreed: Column, webhooks: Column) -> Column:
    """approved, denied or timeout: right signatures alone may do; else all webhook approvers must have answered in time."""
    enough = F.when(signed >= threshold, "approved").when(answered < webhooks, "timeout")
    return enough.when(signed + agreed >= threshold, "approved").otherwise("denied")


def quorum(payments: DataFrame, approvals: DataFrame, approvers: DataFrame, threshold: int, min_amount_usd: float = 0.0, payload: Column | None = None, timeout_seconds: float | None = None, alive: str | None = None, requests: DataFrame | None = None) -> DataFrame:
    """payments with approvals_received and mpa_verdict: exempt, approved, denied or timeout.

    An approval counts once per approver: a signature must be right for the approver's secret (crypto), or the
    approval must say approved (webhook). With timeout_seconds, payments and approvals have `ts`; a webhook's answer
    counts if it comes within that time, and where an answer is missing then and signatures alone don't do, the verdict
    is timeout. Without it, a missing answer is a refusal. Null amounts are denied. alive: a column; rows for which it is
    false get nulls. requests: what approvals are checked against, if not payments themselves: a frame of the same
    payments that costs less to make again.
    """
    stopped = ~F.col(alive) if alive else F.lit(False)
    body = payload if payload is not None else crypto.canonical_approval(F.col("resource_url"), F.col("amount_usd"), F.col("network"), F.col("agent_id"), ascii_only=False)
    due = requests if requests is not None else payments.where(~stopped)
    due = due.where(F.col("amount_usd") >= min_amount_usd)
    if approvers.where("mode = 'crypto'").isEmpty():  # nothing signed to compare with
        body = F.lit(None).cast("string")
    given = valid_votes(approvals.join(due.select("payment_id", body.alias("__body")), "payment_id"), approvers, "__body")
    web = F.col("mode") == "webhook"
    if timeout_seconds is not None:
        asked = due.select("payment_id", F.col("ts").alias("__asked"))
        late = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("__asked").cast("timestamp")) > int(timeout_seconds * 1_000_000)
        given = given.join(asked, "payment_id").where(~web | ~F.coalesce(late, F.lit(True)))
    one = given.groupBy("payment_id", "approver_id").agg(F.max("valid").alias("valid"), F.max(web).alias("web"))
    n = lambda c, a: F.count_if(c).alias(a)
    counts = one.groupBy("payment_id").agg(n(F.col("valid"), "__all"), n(F.col("valid") & ~F.col("web"), "__signed"), n(F.col("web"), "__answered"), n(F.col("valid") & F.col("web"), "__agreed"))
    out = payments.join(counts, "payment_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("__all", "__signed", "__answered", "__agreed")})
    if timeout_seconds is None:
        verdict = F.when(F.col("__all") >= threshold, "approved").otherwise("denied")
    else:
        hooks = approvers.where(web).agg(F.count("*").alias("__webhooks"))
        out = out.join(F.broadcast(hooks))  # one row
        verdict = quorum_verdict(threshold, F.col("__signed"), F.col("__answered"), F.col("__agreed"), F.col("__webhooks"))
    verdict = F.when(stopped, None).when(F.col("amount_usd") < min_amount_usd, "exempt").when(F.col("amount_usd").isNull(), "denied").otherwise(verdict)
    return out.withColumn("approvals_received", F.when(~stopped, F.col("__all"))).withColumn("mpa_verdict", verdict).drop("__all", "__signed", "__answered", "__agreed", "__webhooks")
