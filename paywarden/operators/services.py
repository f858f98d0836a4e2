"""Calls to services outside the engine (remote screening, approval webhooks, signers), with errors as data.

A service is given as a factory: connect() returns post(url, body, headers), which returns (status, headers, body) and
raises OSError where nothing is reached. It is pickled with the plan and called once per task; the engine brings no client
of its own. Requests are made by native expressions and answers read by them; only the call itself runs in Python, row by
row, as it waits for the network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto, scalars, urls

Post = Callable[[str, bytes, dict[str, str]], tuple[int, dict[str, str], bytes]]


def _ask(post: Post, url: str, body: bytes, headers: dict[str, str], wait: float, signed: str, good: tuple[int, ...]) -> tuple:
    """One call and at most one repetition, after `wait` seconds, where the service is not reached or fails (5xx)."""
    for last in (False, True):
        try:
            status, got, answer = post(url, body, headers)
        except OSError:
            status, got, answer = None, {}, b""
        if not last and (status is None or 500 <= status < 600):
            time.sleep(wait)
            continue
        error = "unreachable" if status is None else None if status in good else {401: "unauthorized", 429: "rate_limited"}.get(status, "unavailable")
        lower = {k.lower(): v for k, v in got.items()}
        return status, answer.decode("utf-8", "replace") if error is None else None, lower.get(signed), lower.get("retry-after") if status == 429 else None, error
    raise AssertionError


def call(rows: DataFrame, connect: Callable[[], Post], url: Column, body: Column, headers: dict[str, Column] | None = None, wait: float = 0.5, signed: str = "x-mpa-hmac", good: tuple[int, ...] = (200,)) -> DataFrame:
    """rows with status, body (of an answer whose status is good), signature (the header `signed`), retry_after and error.

    error: null, unreachable, unauthorized (401), rate_limited (429, with the seconds its header says) or unavailable.
    A row with a null url is not sent and has nulls.
    """
    pairs = [x for k, v in (headers or {}).items() for x in (F.lit(k), v)]
    src = rows.withColumns({"__url": url, "__body": body, "__headers": F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = None
        for b in batches:
            out = []
            for u, text, named in zip(*(b.column(c).to_pylist() for c in ("__url", "__body", "__headers"))):
                if u is None:
                    out.append((None,) * 5)
                    continue
                post = post or connect()
                out.append(_ask(post, u, (text or "").encode(), {k: v for k, v in named if v is not None}, wait, signed, good))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            kept = [c for c in b.schema.names if c not in ("__url", "__body", "__headers")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], [*kept, "status", "body", "signature", "retry_after", "error"])

    out = src.mapInArrow(run, f"{schema}, status int, body string, signature string, retry_after string, error string")
    return out.withColumn("retry_after", scalars.retry_after(F.col("retry_after")))


def fetch(rows: DataFrame, connect: Callable[[], Post], url: str = "url", token: str | None = None, wait: float = 0.5) -> DataFrame:
    """rows with http_status, x_payment (the header of an answer that asks for a payment), body and error: what a server says
    to a request, with the payment's token where there is one. payments.payment_requests and parse_header go on from there."""
    heads = {"X-PAYMENT": F.col(token)} if token else {}
    out = call(rows, connect, F.col(url), F.lit(""), heads, wait, "x-payment", (200, 402)).drop("retry_after")
    return out.withColumnsRenamed({"status": "http_status", "signature": "x_payment"})


SCREENED = "redacted_resource_url string, redacted_description string, redacted_reason string, entities_found array<struct<entity_type:string,field:string,count:int>>"


def remote_screen(payments: DataFrame, connect: Callable[[], Post], base_url: str, api_key: str, wait: float = 0.5, entities: tuple[str, ...] | None = None, insecure: bool = False) -> DataFrame:
    """payments with clean_<field> of the three fields, pii_entities (each type as often as counted), screening_error and retry_after.

    As detect, done by a service. A field that the answer leaves out stays as it was; after an error (not_json is one
    more) the clean fields are null, so that nothing unscreened goes on. base_url is https unless `insecure`.
    """
    if not base_url.startswith(("https://", "http://") if insecure else ("https://",)):
        raise ValueError("the screening service's url must start with https://")
    fields = ("resource_url", "description", "reason")
    wanted = [F.array(*[F.lit(e) for e in entities]).alias("entities")] if entities is not None else []
    body = F.to_json(F.struct(*[F.coalesce(f, F.lit("")).alias(f) for f in fields], *wanted))
    heads = {"X-API-Key": F.lit(api_key), "Content-Type": F.lit("application/json")}
    out = call(payments, connect, F.lit(base_url.rstrip("/") + "/v1/screen"), body, heads, wait).drop("signature", "status")
    valid = F.coalesce(F.try_parse_json("body").isNotNull() & F.ltrim("body").startswith("{"), F.lit(False))
    out = out.withColumn("screening_error", F.coalesce("error", F.when(~valid, "not_json"))).withColumn("__a", F.from_json("body", SCREENED))
    fine = F.col("screening_error").isNull()
    clean = {f"clean_{f}": F.when(fine, F.coalesce(F.col(f"__a.redacted_{f}"), F.col(f))) for f in fields}
    counted = F.transform(F.coalesce("__a.entities_found", F.array().cast("array<struct<entity_type:string,field:string,count:int>>")), lambda e: F.struct(F.coalesce(e["entity_type"], F.lit("UNKNOWN")).alias("entity_type"), e["field"].alias("field"), F.greatest(F.coalesce(e["count"], F.lit(1)), F.lit(0)).alias("count")))
    return out.withColumns(clean).withColumn("pii_entities", F.when(fine, F.transform(scalars.repeated(counted), lambda e: e["entity_type"]))).drop("__a", "body", "error")


def blocked_hosts(webhooks: DataFrame, hosts: DataFrame, url: str = "webhook_url") -> DataFrame:
    """webhooks with host_error, from a table (host, ip) of what a resolver said: blocked_address if any address of the
    host is in a blocked network, unresolved if there is none; addresses given as such are not looked up."""
    seen = hosts.groupBy(F.lower("host").alias("__h")).agg(F.max(F.coalesce(urls.ip_blocked(F.col("ip")), F.lit(True))).alias("__bad"))
    out = webhooks.withColumn("__host", F.lower(urls.host(F.col(url))))
    out = out.join(seen, out["__host"] == seen["__h"], "left")
    literal = F.col("__host").rlike(r"^[0-9.]+$|:")
    error = F.coalesce(urls.webhook_error(F.col(url)), F.when(~literal, F.when(F.col("__bad").isNull(), "unresolved").when(F.col("__bad"), "blocked_address")))
    return out.withColumn("host_error", error).drop("__host", "__h", "__bad")


def ask_webhooks(payments: DataFrame, approvers: DataFrame, connect: Callable[[], Post], wait: float = 0.5, hosts: DataFrame | None = None) -> DataFrame:
    """Approvals (payment_id, approver_id, signature, approved, reason) from each webhook approver of a few, for quorum.

    A request's body is signed with the approver's secret, if there is one, and then so must the answer be; an answer
    that is not, an error, and a url that the checks refuse are refusals with a reason.
    """
    hooks = approvers.where("mode = 'webhook'").select("approver_id", "webhook_url", "shared_secret")
    hooks = blocked_hosts(hooks, hosts) if hosts is not None else hooks.withColumn("host_error", urls.webhook_error(F.col("webhook_url")))
    inner, outer = crypto.hmac_pads(F.col("shared_secret"))
    hooks = hooks.select("approver_id", "webhook_url", "host_error", inner.alias("i"), outer.alias("o"))
    one = hooks.agg(F.collect_list(F.struct(*hooks.columns)).alias("h"))  # a row that has the configured approvers
    body = F.to_json(F.struct(F.col("payment_id").cast("string").alias("request_id"), "resource_url", "pay_to", "amount", "currency", "network", "amount_usd"))
    asked = payments.select("payment_id", body.alias("request")).join(F.broadcast(one)).select("payment_id", "request", F.inline("h"))
    sign = crypto.hmac_padded(F.col("request"), F.col("i"), F.col("o"))
    heads = {"Content-Type": F.lit("application/json"), "X-MPA-REQUEST-HMAC": F.when(F.col("i").isNotNull(), sign)}
    got = call(asked, connect, F.when(F.col("host_error").isNull(), F.col("webhook_url")), F.col("request"), heads, wait)
    right = F.col("i").isNull() | F.coalesce(crypto.hmac_padded(F.col("body"), F.col("i"), F.col("o")) == F.lower("signature"), F.lit(False))
    answer = F.from_json("body", "approved boolean, reason string")
    bad = F.coalesce("host_error", "error", F.when(~right, F.lit("wrong_signature")))
    return got.select(
        "payment_id", "approver_id", F.lit(None).cast("string").alias("signature"),
        F.coalesce(F.when(bad.isNull(), answer["approved"]), F.lit(False)).alias("approved"), F.coalesce(bad, answer["reason"]).alias("reason"),
    )


def sign(payments: DataFrame, connect: Callable[[], Callable[[dict], str]], where: Column | None = None) -> DataFrame:
    """payments with token and signing_error: what a signer (a function of the payment as a dict, made once per task) says."""
    rows = payments.withColumn("__go", where if where is not None else F.lit(True))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in payments.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = None
        for b in batches:
            tokens, errors = [], []
            for row in b.to_pylist():
                token = error = None
                if row.pop("__go"):
                    signer = signer or connect()
                    try:
                        token = signer(row)
                    except Exception as e:  # whatever a signer raises stops its own payment only
                        error = f"{type(e).__name__}: {e}"
                tokens.append(token)
                errors.append(error)
            kept = [c for c in b.schema.names if c != "__go"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(tokens, pa.string()), pa.array(errors, pa.string())], [*kept, "token", "signing_error"])

    out = rows.mapInArrow(run, f"{schema}, token string, signing_error string")
    return out.withColumn("signing_error", scalars.safe_message(F.col("signing_error")))
