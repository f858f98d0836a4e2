"""Stateful stream operators: replay guard, budgets, quorum and audit chain, each keyed, with the batch folds' rules.

Rows of a key's micro-batch are decided in order of (ts, seq); a row that comes late is decided when it arrives, against
the state as it is. The rows of one key and micro-batch are sorted in memory, so bound a trigger by the source's own
limits (maxFilesPerTrigger, maxOffsetsPerTrigger). State lives in the state store (RocksDB), survives restarts with the
checkpoint and is shared by all tasks; `reset` starts anew.

With a watermark, time is event time: what the state no longer needs is dropped by timers once the watermark has passed
it, and rows older than the watermark are dropped by Spark. Without one, state stays until it is used again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.admission import Budget, Policy, replay_step, valid_votes
from ..operators.audit import chain_step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = [b for b in batches if len(b)]
    return pd.concat(parts).sort_values(["ts", "seq"], kind="stable") if parts else pd.DataFrame(columns=["ts", "seq"])


def _micros(ts) -> int | None:
    return None if pd.isna(ts) else int(pd.Timestamp(ts).value // 1000)


def _number(x) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


class ReplayGuard(StatefulProcessor):
    def __init__(self, ttl_seconds: int, timed: bool):
        self.ttl, self.timed = ttl_seconds * 1_000_000, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        live = before = self.expiry.get()[0] if self.expiry.exists() else None
        out = []
        for r in _rows(rows).itertuples():
            fine, live = replay_step(live, _micros(r.ts), self.ttl)
            out.append((key[0], r.seq, fine))
        if live is not None and live != before:
            self.expiry.update((live,))
            if self.timed:
                self.handle.registerTimer(-(-live // 1000))
        yield pd.DataFrame(out, columns=["replay_fingerprint", "seq", "replay_ok"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.expiry.exists() and self.expiry.get()[0] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.expiry.clear()
        yield pd.DataFrame(columns=["replay_fingerprint", "seq", "replay_ok"])

    def close(self) -> None:
        pass


class BudgetGuard(StatefulProcessor):
    """Input has resource_url's endpoint prefix in `endpoint` (null for none)."""

    def __init__(self, policy: Policy, timed: bool):
        self.policy, self.timed = policy, timed
        self.window = policy.window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ledger = handle.getListState("ledger", "at long, usd double, endpoint string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = Budget(self.policy), []
        held = [tuple(x) for x in self.ledger.get()]
        for at, usd, endpoint in held:
            state.record(at, usd, endpoint or None)
        new, latest = [], None
        for r in _rows(rows).itertuples():
            now, usd, endpoint = _micros(r.ts), _number(r.amount_usd), r.endpoint if isinstance(r.endpoint, str) else None
            verdict, limit = state.decide(now, usd, endpoint)
            if verdict == "allowed":
                new.append((now, usd, endpoint or ""))
            latest = now if latest is None else max(latest, now or latest)
            out.append((key[0], r.seq, verdict, limit))
        if latest is not None:
            stale = sum(x[0] < latest - self.window for x in held)
            if 2 * stale > len(held):  # rewritten seldom, else only added to
                self._keep([x for x in held + new if x[0] >= latest - self.window])
            elif new:
                self.ledger.appendList(new)
        if new and self.timed:
            self.handle.registerTimer((new[-1][0] + self.window) // 1000 + 1)
        yield pd.DataFrame(out, columns=["agent_id", "seq", "policy_verdict", "policy_limit_usd"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.window
        self._keep([tuple(x) for x in self.ledger.get() if x[0] >= since])
        yield pd.DataFrame(columns=["agent_id", "seq", "policy_verdict", "policy_limit_usd"])

    def _keep(self, rows: list[tuple]) -> None:
        if rows:
            self.ledger.put(rows)
        else:  # the store takes no empty list
            self.ledger.clear()

    def close(self) -> None:
        pass


class AuditChain(StatefulProcessor):
    def __init__(self, key: bytes):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prev = handle.getValueState("prev", "hmac string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        prev = self.prev.get()[0] if self.prev.exists() else None
        out = []
        for r in _rows(rows).itertuples():
            raw, (after,) = chain_step(prev, r.body if isinstance(r.body, str) else None, self.key)
            out.append((key[0], r.seq, prev if raw is not None else None, raw))
            prev = after
        if prev is not None:
            self.prev.update((prev,))
        yield pd.DataFrame(out, columns=["agent_id", "seq", "prev_entry_hmac", "raw"])

    def close(self) -> None:
        pass


class Quorum(StatefulProcessor):
    """Requests and approvals of one payment. A verdict comes once: when signatures do, all webhooks have answered, or time is up.

    Signatures count whenever they come before the verdict; a webhook's answer counts within the timeout of the request.
    """

    COLUMNS = ["payment_id", "approvals_received", "mpa_verdict"]

    def __init__(self, threshold: int, webhooks: int, timeout_seconds: float):
        self.threshold, self.webhooks, self.timeout = threshold, webhooks, int(timeout_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "at long, done boolean")
        self.votes = handle.getMapState("votes", "approver string", "at long, web boolean, valid boolean")

    def _counts(self, until: int) -> tuple[int, int, int]:
        signed = answered = agreed = 0
        for _, (at, web, valid) in self.votes.iterator():
            signed += valid and not web
            answered += web and at <= until
            agreed += valid and web and at <= until
        return signed, answered, agreed

    def _settle(self, key, signed: int, agreed: int, verdict: str, at: int) -> pd.DataFrame:
        self.asked.update((at, True))
        self.votes.clear()
        return pd.DataFrame([(key[0], signed + agreed, verdict)], columns=self.COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, done = self.asked.get() if self.asked.exists() else (None, False)
        for r in _rows(rows).itertuples():
            now = _micros(r.ts)
            if r.approver_id is None or pd.isna(r.approver_id):
                if at is None:
                    at = now
                    self.asked.update((at, False))
                    self.handle.registerTimer((at + self.timeout) // 1000 + 1)
            elif not done:
                web = r.mode == "webhook"
                old = self.votes.getValue((r.approver_id,)) if self.votes.containsKey((r.approver_id,)) else None
                if old is None or bool(r.valid) and not old[2]:
                    self.votes.updateValue((r.approver_id,), (now, web, bool(r.valid)))
                if at is None and old is None:  # a vote for a request that may never come
                    self.handle.registerTimer((now + self.timeout) // 1000 + 1)
        if at is not None and not done:
            signed, answered, agreed = self._counts(at + self.timeout)
            if signed >= self.threshold:
                yield self._settle(key, signed, agreed, "approved", at)
                return
            if answered >= self.webhooks:
                yield self._settle(key, signed, agreed, "approved" if signed + agreed >= self.threshold else "denied", at)
                return
        yield pd.DataFrame(columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, done = self.asked.get() if self.asked.exists() else (None, True)
        if at is not None and expiredTimerInfo.getExpiryTimeInMs() * 1000 <= at + self.timeout:
            yield pd.DataFrame(columns=self.COLUMNS)  # an early vote's timer; the request has its own
            return
        if not done:
            signed, _, agreed = self._counts(at + self.timeout)
            yield self._settle(key, signed, agreed, "timeout", at)
        else:
            yield pd.DataFrame(columns=self.COLUMNS)
        self.votes.clear()
        self.asked.clear()

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, watermark: str | None) -> DataFrame:
    if watermark is not None:
        df = df.withWatermark("ts", watermark)
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "None" if watermark is None else "EventTime")


def replay_stream(df: DataFrame, ttl_seconds: int = 300, watermark: str | None = None) -> DataFrame:
    """(replay_fingerprint, seq, replay_ok); with a watermark an expired fingerprint's state is dropped."""
    return _keyed(df, "replay_fingerprint", ReplayGuard(ttl_seconds, watermark is not None), "replay_fingerprint string, seq long, replay_ok boolean", watermark)


def budget_stream(df: DataFrame, policy: Policy, watermark: str | None = None) -> DataFrame:
    """(agent_id, seq, policy_verdict, policy_limit_usd); with a watermark the ledgers of silent agents are dropped."""
    return _keyed(df, "agent_id", BudgetGuard(policy, watermark is not None), "agent_id long, seq long, policy_verdict string, policy_limit_usd double", watermark)


def chain_stream(df: DataFrame, key: bytes) -> DataFrame:
    return _keyed(df, "agent_id", AuditChain(key), "agent_id string, seq long, prev_entry_hmac string, raw string", None)


def quorum_stream(events: DataFrame, approvers: DataFrame, threshold: int, timeout_seconds: float, watermark: str = "1 minute") -> DataFrame:
    """(payment_id, approvals_received, mpa_verdict) of a stream of requests and approvals in one.

    events(payment_id, seq, ts, approver_id, signature, approved, body): rows without an approver are requests; body is
    the text that approvers sign. Answers of unknown approvers are left out.
    """
    asked = events.where(F.col("approver_id").isNull()).select("payment_id", "seq", "ts", "approver_id", F.lit(None).cast("string").alias("mode"), F.lit(False).alias("valid"))
    votes = valid_votes(events.where(F.col("approver_id").isNotNull()), approvers, "body").select(*asked.columns)
    webhooks = approvers.where("mode = 'webhook'").count()  # a static table of a few approvers
    return _keyed(asked.unionByName(votes), "payment_id", Quorum(threshold, webhooks, timeout_seconds), "payment_id long, approvals_received long, mpa_verdict string", watermark)


#: Audit writers by name: a function of a micro-batch's lines and the folder or table it writes to.
WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "files": lambda lines, to: lines.select("raw").write.mode("append").text(to),
    "discard": lambda lines, to: lines.write.format("noop").mode("overwrite").save(),
    "console": lambda lines, to: lines.select("raw").show(20, truncate=False),
}


def register_writer(name: str, writer: Callable[[DataFrame, str], None]) -> None:
    """Plug in an audit writer."""
    WRITERS[name] = writer


def write_audit(lines: DataFrame, writer: str, to: str, checkpoint: str, strict: bool = False, **trigger):
    """Start a query that hands the lines of each micro-batch to a writer.

    A writer's error loses that batch's lines but not the chain, whose state has gone on; with `strict` it stops the query.
    """
    write = WRITERS[writer]

    def each(batch: DataFrame, _: int) -> None:
        try:
            write(batch, to)
        except Exception:
            if strict:
                raise

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def reset(spark: SparkSession, checkpoint: str) -> None:
    """Forget all state of a query that is not running: its next start reads its source from the beginning."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
