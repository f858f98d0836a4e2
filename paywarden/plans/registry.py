"""The registered queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto, scalars, urls
from ..functions.detect import HYPHENS, INVISIBLE, LOOKALIKE, PATTERNS, detect, entity_types, normalise, redact, scan_fields, spans
from ..functions.json_scan import fixed_point, scan_json
from ..operators import admission, audit, ecosystem, evaluation, payments, services
from ..sources import corpus, facade
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = bytes(range(32))
SINCE = "1995-01-01"
POLICY = admission.Policy(150.0, 300.0, {"https://purchase.example.com": 120.0, "https://click.example.com": 200.0})


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


F_SQL = "f AS (SELECT c_custkey AS address, c_mktsegment AS project, n_name AS blockchain FROM customer JOIN nation ON c_nationkey = n_nationkey)"
T_SQL = "t AS (SELECT o_custkey AS \"from\", n_name AS blockchain, o_orderdate AS block_time, o_orderstatus <> 'P' AS success FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
VOLUME = "count(*) AS tx_count, min(block_time) AS first_tx, max(block_time) AS last_tx, count(DISTINCT date_trunc('day', block_time)) AS active_days, round(count(*)::DOUBLE / nullif(count(DISTINCT date_trunc('day', block_time)), 0), 1) AS avg_tx_per_day"
ON = f"ON t.\"from\" = f.address AND t.blockchain = f.blockchain WHERE success AND block_time >= TIMESTAMP '{SINCE}'"
RE2 = {k: p.replace("(?U)", "") for k, p in PATTERNS.items()} | {
    "US_SSN": r"\b(?:00[1-9]|0[1-9][0-9]|[1-57-8][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])[-\s]?(?:0[1-9]|[1-9][0-9])[-\s]?(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})\b"
}
PAY_SQL = "p AS (SELECT event_id AS payment_id, user_id AS agent_id, ts, value AS amount_usd, 'https://' || event_type || '.example.com/' || user_id AS resource_url, '0x' || (user_id % 7) AS pay_to, event_type, props FROM events)"
AUDIT_SQL = """a AS (SELECT event_id AS seq, ts AS timestamp, CASE event_type WHEN 'click' THEN 'PAYMENT_ALLOWED' WHEN 'purchase' THEN 'PII_REDACTED' WHEN 'error' THEN 'PAYMENT_ERROR' WHEN 'signup' THEN 'POLICY_BLOCKED' WHEN 'view' THEN 'REPLAY_BLOCKED' END AS event_type,
 value AS amount_usd, user_id::VARCHAR AS agent_id, CASE WHEN event_type IN ('signup', 'view', 'error') THEN 'blocked' ELSE 'allowed' END AS outcome,
 CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN ['EMAIL_ADDRESS', 'US_SSN'] ELSE ['EMAIL_ADDRESS'] END ELSE []::VARCHAR[] END AS pii FROM events)"""


#: The native part of normalisation. The driver's texts are fixed points of the other part, NFKC, which SQL lacks; tests have texts that are none.
FOLD = f"translate({{}}, '{LOOKALIKE[0]}{HYPHENS}{INVISIBLE}', '{LOOKALIKE[1]}{'-' * len(HYPHENS)}')"


def spans_sql(source: str, key: str) -> str:
    """CTEs up to `kept`: a row per text t of source(key, t) with the list k of its entities {s, e, r, ty, x}, overlaps resolved."""
    one = " UNION ALL ".join(
        f"SELECT {key}, list_transform(range(1, len(m) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(g[1:i], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0), 'n': length(m[i]), 'r': {r}, 'ty': '{k}', 'x': m[i]}}) AS l "
        f"FROM (SELECT {key}, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM {source}) WHERE len(m) > 0"
        for r, (k, p) in enumerate(RE2.items())
    )
    row = "{'s': v.s::INT, 'e': (v.s + v.n)::INT, 'r': v.r, 'o': [{'s': v.s::INT, 'e': (v.s + v.n)::INT, 'ty': v.ty, 'x': v.x}]}"
    return f"""hits AS ({one}), flat AS (SELECT {key}, list_sort(flatten(list(list_transform(l, lambda v: {row})))) AS l FROM hits GROUP BY 1),
kept AS (SELECT {key}, list_reduce(l, lambda a, v: CASE WHEN v.s >= a.e THEN {{'s': a.s, 'e': v.e, 'r': a.r, 'o': list_concat(a.o, v.o)}} ELSE a END).o AS k FROM flat)"""


def hmac_sql(message: str, key: bytes = KEY) -> str:
    pad = lambda x: bytes(b ^ x for b in key.ljust(64, b"\0")).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode({message}))))"


# ---------------------------------------------------------------- volume


@query(f"WITH {F_SQL} SELECT blockchain, project, count(*) AS wallet_count, list_sort(list(address))[1:3] AS sample_addresses FROM f GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2")
def facilitator_list(spark, sf):
    return ecosystem.facilitator_list(facade.facilitators(spark, sf))


@query(f"WITH {F_SQL}, {T_SQL} SELECT f.blockchain, project, {VOLUME} FROM t JOIN f {ON} GROUP BY 1, 2 ORDER BY tx_count DESC, 1, 2 LIMIT 100")
def volume_by_chain_project(spark, sf):
    return ecosystem.by_chain_and_project(facade.facilitators(spark, sf), facade.transactions(spark, sf), SINCE)


@query(f"WITH {F_SQL}, {T_SQL} SELECT project, {VOLUME} FROM t JOIN f {ON} AND f.blockchain = 'NATION_0' GROUP BY 1")
def volume_single_chain(spark, sf):
    return ecosystem.single_chain(facade.facilitators(spark, sf), facade.transactions(spark, sf), "NATION_0", SINCE)


@query(f"WITH {F_SQL}, {T_SQL} SELECT * EXCLUDE (first_tx) FROM (SELECT f.blockchain, project, {VOLUME} FROM t JOIN f {ON} AND f.blockchain NOT IN ('NATION_0', 'NATION_1') GROUP BY 1, 2)")
def volume_other_chains(spark, sf):
    return ecosystem.other_chains(facade.facilitators(spark, sf), facade.transactions(spark, sf), ("NATION_0", "NATION_1"), SINCE)


@query(f"WITH {F_SQL}, {T_SQL} SELECT count(*) AS tx_count, min(block_time) AS first_tx, max(block_time) AS last_tx FROM t WHERE success AND block_time >= TIMESTAMP '{SINCE}' AND blockchain = 'NATION_2' AND \"from\" IN (SELECT address FROM f WHERE blockchain = 'NATION_2')")
def volume_chain_fallback(spark, sf):
    return ecosystem.chain_totals(facade.facilitators(spark, sf), facade.transactions(spark, sf), "NATION_2", SINCE)


@query(f"WITH {F_SQL} SELECT address::VARCHAR AS address, project, blockchain FROM f WHERE lower(address::VARCHAR) IN ('1','5','11','77','100','149','500','901','1200','1400')")
def resolve_unknowns(spark, sf):
    return ecosystem.resolve_unknowns(facade.facilitators(spark, sf), ("1", "5", "11", "77", "100", "149", "500", "901", "1200", "1400"))


# ---------------------------------------------------------------- personal data


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS entity_type, len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS n FROM documents" for k, p in RE2.items()) + ") SELECT entity_type, sum(n)::BIGINT AS n FROM m GROUP BY 1")
def pii_counts_by_type(spark, sf):
    t = F.col("text")
    one = F.array(*[F.struct(F.lit(k).alias("entity_type"), F.size(spans(t, k)).cast("long").alias("n")) for k in PATTERNS])
    return facade.table(spark, sf, "documents").select(F.inline(one)).groupBy("entity_type").agg(F.sum("n").alias("n"))


@query("SELECT conv_id, turn, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS n_{k.lower()}" for k, p in RE2.items()) + " FROM conversations")
def pii_per_turn(spark, sf):
    return facade.table(spark, sf, "conversations").select("conv_id", "turn", *[F.size(spans(F.col("text"), k)).cast("long").alias(f"n_{k.lower()}") for k in PATTERNS])


DOCS_SQL = f"d AS (SELECT doc_id, {FOLD.format('text')} AS t FROM documents)"
REDACT_SQL = "list_aggregate(list_transform(k, lambda v, i: substr(t, CASE WHEN i = 1 THEN 1 ELSE k[i - 1].e + 1 END, v.s - CASE WHEN i = 1 THEN 0 ELSE k[i - 1].e END) || {}), 'string_agg', '') || substr(t, k[-1].e + 1)"


@query(f"""WITH {DOCS_SQL}, {spans_sql('d', 'doc_id')} SELECT doc_id, CASE WHEN k IS NULL THEN t ELSE {REDACT_SQL.format("'[REDACTED:' || v.ty || ']'")} END AS clean, coalesce(len(k), 0)::INT AS n,
 coalesce(list_sort(list_distinct(list_transform(k, lambda v: v.ty))), []::VARCHAR[]) AS types FROM d LEFT JOIN kept USING (doc_id)""")
def pii_redacted(spark, sf):
    d = facade.table(spark, sf, "documents").select("doc_id", normalise(F.col("text")).alias("t")).withColumn("found", detect(F.col("t")))
    return d.select("doc_id", redact(F.col("t"), F.col("found"), "[REDACTED:{entity_type}]").alias("clean"), F.size("found").alias("n"), entity_types(F.col("found")).alias("types"))


@query(f'WITH {DOCS_SQL}, {spans_sql("d", "doc_id")} SELECT doc_id, v.s AS "start", v.e AS "end", v.ty AS entity_type, v.x AS original_text FROM (SELECT doc_id, unnest(k) AS v FROM kept)')
def pii_spans(spark, sf):
    d = facade.table(spark, sf, "documents").select("doc_id", normalise(F.col("text")).alias("t"))
    return d.select("doc_id", F.inline(detect(F.col("t")))).drop("rank")


@query(f"SELECT doc_id, sha256({FOLD.format('text')}) AS clean_sha256 FROM documents")
def pii_normalised(spark, sf):
    return facade.table(spark, sf, "documents").select("doc_id", F.sha2(normalise(F.col("text")), 256).alias("clean_sha256"))


def _fields(spark, sf):
    """Three fields of payment metadata per turn of a conversation; every ninth has a mail address in its reason."""
    c = facade.table(spark, sf, "conversations")
    url = F.concat(F.lit("https://api.example.com/"), "conv_id", F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("/user"), "conv_id", F.lit("@example.com"))).otherwise(F.lit("")))
    reason = F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("for bob"), "turn", F.lit("@example.org"))).otherwise(F.lit("none"))
    return c.select("conv_id", "turn", normalise(url).alias("resource_url"), normalise(F.col("text")).alias("description"), normalise(reason).alias("reason"))


@query(
    "WITH c AS (SELECT conv_id, turn, 'https://api.example.com/' || conv_id || CASE WHEN conv_id % 5 = 0 THEN '/user' || conv_id || '@example.com' ELSE '' END AS u, text AS d, CASE WHEN conv_id % 9 = 0 THEN 'for bob' || turn || '@example.org' ELSE 'none' END AS r FROM conversations), "
    f"f AS (SELECT conv_id, turn, 0 AS p, 'resource_url' AS field, u AS t FROM c UNION ALL SELECT conv_id, turn, 1, 'description', {FOLD.format('d')} FROM c UNION ALL SELECT conv_id, turn, 2, 'reason', r FROM c), n AS (SELECT *, row_number() OVER () AS id FROM f), {spans_sql('n', 'id')}, "
    "x AS (SELECT conv_id, turn, p, field, unnest(k) AS v FROM n JOIN kept USING (id)) SELECT conv_id, turn, field, v.ty AS entity_type, v.s AS \"start\", v.e AS \"end\", 1.0::DOUBLE AS score, v.x AS original_text FROM x"
)
def field_scan(spark, sf):
    f = _fields(spark, sf)
    return f.select("conv_id", "turn", F.inline(scan_fields({c: F.col(c) for c in pipeline.FIELDS}, min_score=0.5)))


@query(
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS config, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for k, p in RE2.items())
    + ") SELECT config, count(*) FILTER (n > 0) AS texts_with_any, sum(n)::BIGINT AS entities FROM c GROUP BY 1"
)
def pii_subset_sweep(spark, sf):
    return evaluation.sweep(facade.table(spark, sf, "documents"), subsets=evaluation.SUBSETS[:-1])


@query()
def pii_full_sweep(spark, sf):
    """All subsets, with that of all types, where overlaps between types are resolved; SQL counts single types only."""
    return evaluation.sweep(facade.table(spark, sf, "documents"))


@query("""SELECT event_id, '{"contacts":[{"mail":"<REDACTED>"}],"props":' || replace(props, ': ', ':') || '}' AS clean, ['EMAIL_ADDRESS'] AS entity_types, true AS valid FROM events""")
def json_scan(spark, sf):
    e = facade.table(spark, sf, "events")
    nested = F.concat(F.lit('{"contacts":[{"mail":"u'), F.col("user_id").cast("string"), F.lit('@example.com"}],"props":'), "props", F.lit("}"))
    return e.select("event_id", scan_json(nested).alias("s")).select("event_id", "s.clean", "s.entity_types", "s.valid")


# ---------------------------------------------------------------- payments


@query(
    f"WITH {PAY_SQL}, h AS (SELECT *, CASE WHEN payment_id % 5 = 0 THEN 'not json' WHEN payment_id % 7 = 0 THEN '{{\"accepts\":[]}}' ELSE '{{\"accepts\":[{{\"scheme\":\"upto\"}},{{\"scheme\":\"exact\",\"network\":\"base\",\"maxAmountRequired\":\"' || payment_id || '\",\"resource\":\"' || resource_url || '\",\"payTo\":\"' || pay_to || '\"}}]}}' END AS x FROM p) "
    "SELECT payment_id, CASE WHEN payment_id % 5 = 0 THEN 'invalid_json' WHEN payment_id % 7 = 0 THEN 'no_offers' END AS header_error, x ->> '$.accepts[1].resource' AS resource_url, x ->> '$.accepts[1].maxAmountRequired' AS amount, 'USDC' AS currency, 300 AS deadline_seconds FROM (SELECT payment_id, CASE WHEN payment_id % 5 = 0 THEN NULL ELSE x END AS x FROM h)"
)
def header_parse(spark, sf):
    p = facade.payments(spark, sf)
    body = F.concat(F.lit('{"accepts":[{"scheme":"upto"},{"scheme":"exact","network":"base","maxAmountRequired":"'), F.col("payment_id").cast("string"), F.lit('","resource":"'), "resource_url", F.lit('","payTo":"'), "pay_to", F.lit('"}]}'))
    header = F.when(F.col("payment_id") % 5 == 0, "not json").when(F.col("payment_id") % 7 == 0, '{"accepts":[]}').otherwise(body)
    out = p.select("payment_id", payments.parse_header(header).alias("h"))
    return out.select("payment_id", "h.header_error", "h.resource_url", "h.amount", "h.currency", "h.deadline_seconds")


@query(
    "WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'nan' WHEN 1 THEN '-1.0' WHEN 2 THEN 'inf' WHEN 3 THEN '1_0.5' ELSE value::VARCHAR END AS amount, CASE WHEN event_id % 11 = 0 THEN 'eur' ELSE 'usdc' END AS currency FROM events) "
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'not_a_number' WHEN 1 THEN 'negative' WHEN 2 THEN 'not_a_number' ELSE CASE WHEN currency = 'eur' THEN 'unsupported_currency' END END AS error, CASE WHEN event_id % 6 < 3 OR currency = 'eur' THEN NULL ELSE replace(amount, '_', '')::DOUBLE END AS usd FROM v"
)
def amount_usd(spark, sf):
    e = facade.table(spark, sf, "events")
    k = F.col("event_id") % 6
    amount = F.when(k == 0, "nan").when(k == 1, "-1.0").when(k == 2, "inf").when(k == 3, "1_0.5").otherwise(F.col("value").cast("string"))
    currency = F.when(F.col("event_id") % 11 == 0, "eur").otherwise("usdc")
    return e.select("event_id", scalars.amount_error(amount, currency).alias("error"), scalars.amount_usd(amount, currency).alias("usd"))


@query(f"WITH {PAY_SQL} SELECT payment_id, {hmac_sql(chr(39).join(['concat_ws(', '|', ', resource_url, pay_to, payment_id::VARCHAR, ', 'USDC', ', ', '300', ')']))} AS fingerprint FROM p")
def payment_fingerprint(spark, sf):
    p = facade.payments(spark, sf)
    return p.select("payment_id", crypto.fingerprint(F.col("resource_url"), F.col("pay_to"), F.col("payment_id").cast("string"), F.col("currency"), F.col("deadline_seconds"), KEY).alias("fingerprint"))


@query(f"WITH {PAY_SQL} SELECT payment_id, NOT (agent_id % 3 = 0 AND event_type = 'click') OR pay_to IN ('0x0', '0x3') AS wallet_ok FROM p")
def wallet_allowlist(spark, sf):
    p = facade.payments(spark, sf).withColumn("resource_url", F.when((F.col("agent_id") % 3 == 0) & (F.col("event_type") == "click"), F.lit("HTTPS://Click.Example.com:443/x")).otherwise(F.lit("https://free.example.com/")))
    trusted = spark.createDataFrame([("https://click.example.com/", "0x0"), ("https://click.example.com", "0x3")], "origin string, wallet string")
    return admission.wallet_check(p, trusted).select("payment_id", "wallet_ok")




@query("""
WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  CASE event_type WHEN 'purchase' THEN 120.0 WHEN 'click' THEN 200.0 END AS cap FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS verdict, []::STRUCT(t BIGINT, v DOUBLE, e VARCHAR)[] AS w FROM events GROUP BY user_id
 UNION ALL
 SELECT user_id, n, event_id, verdict, CASE WHEN verdict = 'allowed' THEN list_append(w, {'t': t, 'v': v, 'e': event_type}) ELSE w END
 FROM (SELECT user_id, n, event_id, t, v, event_type, w, CASE WHEN v > 150 THEN 'per_call'
   WHEN list_reduce(list_transform(w, lambda x: x.v), lambda a, b: a + b, 0.0::DOUBLE) + v > 300 THEN 'daily_limit'
   WHEN cap IS NOT NULL AND list_reduce(list_transform(list_filter(w, lambda x: x.e = event_type), lambda x: x.v), lambda a, b: a + b, 0.0::DOUBLE) + v > cap THEN 'per_endpoint' ELSE 'allowed' END AS verdict
  FROM (SELECT o.*, list_filter(s.w, lambda x: x.t >= o.t - 86400000000) AS w FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)))
SELECT event_id AS payment_id, verdict AS policy_verdict FROM s WHERE n > 0""")
def budget_decisions(spark, sf):
    return admission.budget_decisions(facade.payments(spark, sf), POLICY).select("payment_id", "policy_verdict")


@query("""
WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_type, n, event_id, true AS ok, t + 86400000000 AS expiry FROM o WHERE n = 1
 UNION ALL SELECT o.user_id, o.event_type, o.n, o.event_id, s.expiry <= o.t, CASE WHEN s.expiry <= o.t THEN o.t + 86400000000 ELSE s.expiry END FROM s JOIN o ON o.user_id = s.user_id AND o.event_type = s.event_type AND o.n = s.n + 1)
SELECT event_id AS payment_id, ok AS replay_ok FROM s""")
def replay_decisions(spark, sf):
    p = facade.payments(spark, sf).withColumn("replay_fingerprint", crypto.fingerprint(F.col("resource_url"), F.col("pay_to"), F.lit("1"), F.col("currency"), F.col("deadline_seconds"), KEY))
    return admission.replay_decisions(p, 86_400).select("payment_id", "replay_ok")


@query(f"WITH {PAY_SQL} SELECT payment_id, round(sum(amount_usd) OVER (PARTITION BY agent_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 4) AS rolling_usd FROM p")
def rolling_spend(spark, sf):
    return admission.rolling_spend(facade.payments(spark, sf)).select("payment_id", F.round("rolling_usd", 4).alias("rolling_usd"))


@query("""
WITH p AS (SELECT event_id, value, event_id % 4 AS k FROM events),
g AS (SELECT event_id, value, k, (k >= 1)::INT + (k >= 2)::INT AS n FROM p)
SELECT event_id AS payment_id, CASE WHEN value < 20 THEN 0 ELSE n END::BIGINT AS approvals_received, CASE WHEN value < 20 THEN 'exempt' WHEN n >= 2 THEN 'approved' ELSE 'denied' END AS mpa_verdict FROM g""")
def quorum_decisions(spark, sf):
    p = facade.payments(spark, sf)
    body = crypto.canonical_approval(F.col("resource_url"), F.col("amount_usd"), F.col("network"), F.col("agent_id"), ascii_only=False)
    k = F.col("payment_id") % 4
    secret = b"a shared secret of alice, longer than a block of the hash, which is why it is hashed first"
    p = p.withColumn("good", F.upper(crypto.hmac_sha256(body, secret)))
    good = F.col("good")
    rows = F.array(
        F.struct(F.lit("alice").alias("approver_id"), F.when(k >= 1, good).otherwise("00").alias("signature"), F.lit(None).cast("boolean").alias("approved")),
        F.struct(F.lit("alice").alias("approver_id"), F.when(k >= 1, good).otherwise("00").alias("signature"), F.lit(None).cast("boolean").alias("approved")),
        F.struct(F.lit("bob").alias("approver_id"), F.lit(None).cast("string").alias("signature"), (k >= 2).alias("approved")),
        F.struct(F.lit("mallory").alias("approver_id"), F.lit(None).cast("string").alias("signature"), F.lit(True).alias("approved")),
    )
    approvals = p.select("payment_id", F.inline(rows))
    approvers = spark.createDataFrame([("alice", "crypto", bytearray(secret)), ("bob", "webhook", None)], "approver_id string, mode string, shared_secret binary")
    return admission.quorum(p, approvals, approvers, 2, 20.0).select("payment_id", "approvals_received", "mpa_verdict")


@query("""
WITH p AS (SELECT event_id, value, event_id % 4 AS k, event_id % 10 AS late FROM events)
SELECT event_id AS payment_id, CASE WHEN value < 20 THEN 0 ELSE (k >= 1)::INT + (k >= 2 AND late < 7)::INT END::BIGINT AS approvals_received,
 CASE WHEN value < 20 THEN 'exempt' WHEN late >= 7 OR k = 3 THEN 'timeout' WHEN (k >= 1)::INT + (k >= 2)::INT >= 2 THEN 'approved' ELSE 'denied' END AS mpa_verdict FROM p""")
def quorum_timeouts(spark, sf):
    """Bob's answers come after 1 s, every tenth to eighth in ten after an hour; carol does not answer where id % 4 is 3."""
    p = facade.payments(spark, sf)
    body = crypto.canonical_approval(F.col("resource_url"), F.col("amount_usd"), F.col("network"), F.col("agent_id"), ascii_only=False)
    k, late = F.col("payment_id") % 4, F.col("payment_id") % 10 >= 7
    secret, null = b"a shared secret of alice", F.lit(None)
    signed = F.struct(F.lit("alice").alias("approver_id"), F.when(k >= 1, F.col("good")).otherwise("00").alias("signature"), null.cast("boolean").alias("approved"), F.col("ts").alias("ts"))
    wait = F.when(late, F.expr("interval 1 hour")).otherwise(F.expr("interval 1 second"))
    bob = F.struct(F.lit("bob").alias("approver_id"), null.cast("string").alias("signature"), (k >= 2).alias("approved"), (F.col("ts") + wait).alias("ts"))
    carol = F.struct(F.lit("carol").alias("approver_id"), null.cast("string").alias("signature"), F.lit(False).alias("approved"), F.col("ts").alias("ts"))
    answers = F.when(k == 3, F.array(signed, bob)).otherwise(F.array(signed, bob, carol))
    approvals = p.withColumn("good", crypto.hmac_sha256(body, secret)).select("payment_id", F.inline(answers))
    approvers = spark.createDataFrame([("alice", "crypto", bytearray(secret)), ("bob", "webhook", None), ("carol", "webhook", None)], "approver_id string, mode string, shared_secret binary")
    return admission.quorum(p, approvals, approvers, 2, 20.0, timeout_seconds=60).select("payment_id", "approvals_received", "mpa_verdict")


DECIDE_SQL = """
p AS (SELECT event_id AS id, user_id AS u, event_type AS y, epoch_us(ts) AS t, CASE WHEN event_id % 50 = 0 THEN 'nan' WHEN event_id % 50 = 1 THEN '-1.0' ELSE value::VARCHAR END AS amount, CASE WHEN event_id % 50 = 2 THEN 'eur' ELSE 'USDC' END AS currency, value AS v, '0x' || (user_id % 7) AS w FROM events),
e AS (SELECT *, CASE WHEN amount = 'nan' THEN 'not_a_number' WHEN amount = '-1.0' THEN 'negative' WHEN currency = 'eur' THEN 'unsupported_currency' END AS error, list_concat(CASE WHEN id % 9 = 0 THEN ['EMAIL_ADDRESS'] ELSE []::VARCHAR[] END, CASE WHEN id % 11 = 0 THEN ['US_SSN'] ELSE []::VARCHAR[] END) AS pii FROM p),
early AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'payment_error' WHEN y = 'error' AND w NOT IN ('0x1', '0x2') THEN 'wallet_blocked' END AS verdict FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t, id) AS n, CASE y WHEN 'purchase' THEN 120.0 WHEN 'click' THEN 200.0 END AS cap FROM early WHERE verdict IS NULL),
s AS (SELECT u, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS policy_verdict, []::STRUCT(t BIGINT, v DOUBLE, e VARCHAR)[] AS l FROM o GROUP BY u
 UNION ALL
 SELECT u, n, id, policy_verdict, CASE WHEN policy_verdict = 'allowed' THEN list_append(l, {'t': t, 'v': v, 'e': y}) ELSE l END
 FROM (SELECT u, n, id, t, v, y, l, CASE WHEN v > 150 THEN 'per_call'
   WHEN list_reduce(list_transform(l, lambda x: x.v), lambda a, b: a + b, 0.0::DOUBLE) + v > 300 THEN 'daily_limit'
   WHEN cap IS NOT NULL AND list_reduce(list_transform(list_filter(l, lambda x: x.e = y), lambda x: x.v), lambda a, b: a + b, 0.0::DOUBLE) + v > cap THEN 'per_endpoint' ELSE 'allowed' END AS policy_verdict
  FROM (SELECT o.*, list_filter(s.l, lambda x: x.t >= o.t - 86400000000) AS l FROM s JOIN o ON o.u = s.u AND o.n = s.n + 1))),
f AS (SELECT o.id, o.u, o.y, o.amount, o.t, row_number() OVER (PARTITION BY o.u, o.y, o.amount ORDER BY o.t, o.id) AS m FROM o JOIN s ON s.id = o.id WHERE s.policy_verdict = 'allowed'),
r AS (SELECT u, y, amount, m, id, true AS replay_ok, t + 86400000000 AS expiry FROM f WHERE m = 1
 UNION ALL SELECT f.u, f.y, f.amount, f.m, f.id, r.expiry <= f.t, CASE WHEN r.expiry <= f.t THEN f.t + 86400000000 ELSE r.expiry END FROM r JOIN f ON f.u = r.u AND f.y = r.y AND f.amount = r.amount AND f.m = r.m + 1),
d AS (SELECT e.*, s.policy_verdict, r.replay_ok, CASE WHEN r.replay_ok THEN CASE WHEN e.v < 50 THEN 'exempt' WHEN e.id % 3 <> 0 THEN 'approved' ELSE 'denied' END END AS mpa_verdict, early.verdict AS first FROM e JOIN early ON early.id = e.id LEFT JOIN s ON s.id = e.id LEFT JOIN r ON r.id = e.id),
z AS (SELECT *, coalesce(first, CASE WHEN policy_verdict <> 'allowed' THEN 'policy_blocked' WHEN NOT replay_ok THEN 'replay_blocked' WHEN mpa_verdict = 'denied' THEN 'mpa_blocked' ELSE 'allowed' END) AS verdict FROM d)
"""


def _decided(spark, sf):
    """Decisions on payments of which some have a bad amount or currency, a mail address as their reason, or a number in their extra data."""
    k = F.col("payment_id") % 50
    p = facade.payments(spark, sf).withColumns({
        "amount": F.when(k == 0, "nan").when(k == 1, "-1.0").otherwise(F.col("amount")), "currency": F.when(k == 2, "eur").otherwise(F.col("currency")), "description": F.lit("one call"),
        "reason": F.when(F.col("payment_id") % 9 == 0, "for \uff42ob\uff20example.com").otherwise("none"), "extra": F.when(F.col("payment_id") % 11 == 0, '{"note":["ssn 219-45-6789"]}').otherwise(F.col("extra")),
    })
    trusted = spark.createDataFrame([("https://error.example.com", "0x1"), ("https://error.example.com", "0x2")], "origin string, wallet string")
    approvals = p.where("payment_id % 3 <> 0").select("payment_id", F.lit("bob").alias("approver_id"), F.lit(None).cast("string").alias("signature"), F.lit(True).alias("approved"))
    approvers = spark.createDataFrame([("bob", "webhook", None)], "approver_id string, mode string, shared_secret binary")
    return pipeline.decide(p, POLICY, trusted, KEY, approvals, approvers, threshold=1, min_amount_usd=50.0, ttl_seconds=86_400)


@query(f"WITH RECURSIVE {DECIDE_SQL} SELECT id AS payment_id, u AS agent_id, pii AS pii_types, CASE WHEN id % 9 = 0 THEN 'for <REDACTED>' ELSE 'none' END AS clean_reason, error, policy_verdict, replay_ok, mpa_verdict, verdict FROM z")
def decision_pipeline(spark, sf):
    return _decided(spark, sf).select("payment_id", "agent_id", "pii_types", "clean_reason", "error", "policy_verdict", "replay_ok", "mpa_verdict", "verdict")


@query(f"""WITH RECURSIVE {DECIDE_SQL}, l AS (SELECT * FROM z), a AS (
 SELECT id, u, 0 AS n, 'PII_REDACTED' AS event_type, 'allowed' AS outcome, pii AS found, NULL::DOUBLE AS lim, NULL::VARCHAR AS msg FROM l WHERE len(pii) > 0 AND verdict <> 'payment_error'
 UNION ALL SELECT id, u, CASE WHEN len(pii) > 0 AND verdict <> 'payment_error' THEN 1 ELSE 0 END,
  CASE verdict WHEN 'payment_error' THEN 'PAYMENT_ERROR' WHEN 'wallet_blocked' THEN 'WALLET_BLOCKED' WHEN 'policy_blocked' THEN 'POLICY_BLOCKED' WHEN 'replay_blocked' THEN 'REPLAY_BLOCKED' WHEN 'mpa_blocked' THEN 'MPA_BLOCKED' ELSE 'PAYMENT_ALLOWED' END,
  CASE WHEN verdict = 'allowed' THEN 'allowed' ELSE 'blocked' END, []::VARCHAR[], CASE policy_verdict WHEN 'per_call' THEN 150.0 WHEN 'daily_limit' THEN 300.0 WHEN 'per_endpoint' THEN CASE y WHEN 'purchase' THEN 120.0 ELSE 200.0 END END::DOUBLE,
  CASE verdict WHEN 'payment_error' THEN 'payment cannot be read: ' || error WHEN 'wallet_blocked' THEN 'wallet not listed for origin' WHEN 'policy_blocked' THEN 'limit exceeded' WHEN 'replay_blocked' THEN 'seen before' WHEN 'mpa_blocked' THEN 'approvals refused' END FROM l)
SELECT id AS payment_id, u AS agent_id, n, event_type, outcome, found AS pii_entities_found, lim AS policy_limit_usd, msg AS error_message FROM a""")
def decision_audit(spark, sf):
    return pipeline.audit_events(_decided(spark, sf)).select("payment_id", "agent_id", "n", "event_type", "outcome", "pii_entities_found", "policy_limit_usd", "error_message")


@query(f"""WITH RECURSIVE {DECIDE_SQL}, c AS (
 SELECT 'payments_total' AS metric, CASE WHEN verdict = 'allowed' THEN 'allowed' ELSE 'blocked' END AS label_a, CASE verdict WHEN 'allowed' THEN 'none' WHEN 'payment_error' THEN 'error' ELSE replace(verdict, '_blocked', '') END AS label_b FROM z
 UNION ALL SELECT 'policy_violations_total', policy_verdict, '' FROM z WHERE verdict = 'policy_blocked' UNION ALL SELECT 'replay_detections_total', '', '' FROM z WHERE verdict = 'replay_blocked'
 UNION ALL SELECT 'mpa_events_total', mpa_verdict, '' FROM z WHERE mpa_verdict IN ('approved', 'denied', 'timeout') UNION ALL SELECT 'pii_detections_total', unnest(pii), 'redact' FROM z WHERE verdict <> 'payment_error')
SELECT metric, label_a, label_b, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def decision_metrics(spark, sf):
    return pipeline.metrics(_decided(spark, sf))


@query("SELECT event_id, props AS x_payment FROM events WHERE event_id % 3 = 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0")
def payment_required(spark, sf):
    """Responses that ask for a payment: others have another status, no header or an empty one."""
    e = facade.table(spark, sf, "events")
    header = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 7 == 0, "").otherwise(F.col("props"))
    status = F.when(F.col("event_id") % 3 == 0, 402).otherwise(200)
    return payments.payment_requests(e.select("event_id", status.alias("http_status"), header.alias("x_payment"))).select("event_id", "x_payment")


# ---------------------------------------------------------------- services


def _screening_service():
    """A stand-in for a screening service, which answers by the number in the description."""
    asked: dict[int, int] = {}

    def post(url: str, body: bytes, headers: dict[str, str]):
        sent = json.loads(body)
        n = int(sent["description"])
        asked[n] = asked.get(n, 0) + 1
        if n % 8 == 3 or headers["X-API-Key"] != "key" or not url.endswith("/v1/screen"):
            raise OSError("nothing there")
        if n % 8 == 2 and asked[n] == 1:
            return 503, {}, b""
        good = {"redacted_reason": "for <REDACTED>", "entities_found": [{"entity_type": "EMAIL_ADDRESS", "count": 2}, {"entity_type": "PERSON"}]}
        return {0: (401, {}, b""), 1: (429, {"Retry-After": str(n - 50)}, b""), 4: (200, {}, b"<html>"), 5: (404, {}, b""), 6: (200, {}, b"{}")}.get(n % 8, (200, {}, json.dumps(good).encode()))

    return post


@query("""WITH p AS (SELECT event_id AS id, event_id % 8 AS k FROM events) SELECT id AS payment_id, CASE WHEN k IN (2, 7) THEN 'for <REDACTED>' WHEN k = 6 THEN 'for a@b.co' END AS clean_reason,
 CASE WHEN k IN (2, 7) THEN ['EMAIL_ADDRESS', 'EMAIL_ADDRESS', 'PERSON'] WHEN k = 6 THEN []::VARCHAR[] END AS pii_entities, CASE k WHEN 0 THEN 'unauthorized' WHEN 1 THEN 'rate_limited' WHEN 3 THEN 'unreachable' WHEN 4 THEN 'not_json' WHEN 5 THEN 'unavailable' END AS screening_error,
 CASE WHEN k = 1 THEN greatest(0, id - 50) END::INT AS retry_after FROM p""")
def remote_screening(spark, sf):
    p = facade.payments(spark, sf).withColumns({"description": F.col("payment_id").cast("string"), "reason": F.lit("for a@b.co")})
    return services.remote_screen(p, _screening_service, "https://screen.example.com/", "key", wait=0.0).select("payment_id", "clean_reason", "pii_entities", "screening_error", "retry_after")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages) SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'blocked_address' WHEN 2 THEN 'blocked_address' END AS host_error FROM p""")
def webhook_hosts(spark, sf):
    """Urls whose host has no address, a private one among others, or a public one only; and one given as an address."""
    p, k = facade.table(spark, sf, "pages"), F.col("page_id") % 4
    url = F.when(k == 2, "https://192.168.3.4/hook").otherwise(F.concat(F.lit("https://User@H"), "page_id", F.lit(".Example.com:8443/hook")))
    hooks = p.select("page_id", url.alias("webhook_url"))
    addresses = F.when(k == 1, F.array(F.lit("9.9.9.9"), F.lit("10.0.0.7"))).when(k == 3, F.array(F.lit("9.9.9.9"))).otherwise(F.array().cast("array<string>"))
    hosts = p.select(F.concat(F.lit("h"), "page_id", F.lit(".example.com")).alias("host"), F.explode(addresses).alias("ip"))
    return services.blocked_hosts(hooks, hosts).select("page_id", "host_error")


def _approver_service():
    """A stand-in for approvers' webhooks: the request must be signed; the answer is by the payment's number."""

    def post(url: str, body: bytes, headers: dict[str, str]):
        n = int(json.loads(body)["request_id"])
        secret = None if "open" in url else KEY
        if secret and headers.get("X-MPA-REQUEST-HMAC") != hmac.new(secret, body, hashlib.sha256).hexdigest():
            return 403, {}, b""
        answer = json.dumps({"approved": n % 3 != 0, "reason": None if n % 3 else "too much"}).encode()
        made = hmac.new(secret if n % 5 else b"wrong", answer, hashlib.sha256).hexdigest() if secret else ""
        return 200, {"X-MPA-HMAC": made.upper()}, answer

    return post


@query("""WITH p AS (SELECT event_id AS id FROM events) SELECT id AS payment_id, 'bob' AS approver_id, id % 3 <> 0 AND id % 5 <> 0 AS approved, CASE WHEN id % 5 = 0 THEN 'wrong_signature' WHEN id % 3 = 0 THEN 'too much' END AS reason FROM p
 UNION ALL SELECT id, 'carol', id % 3 <> 0, CASE WHEN id % 3 = 0 THEN 'too much' END FROM p UNION ALL SELECT id, 'dave', false, 'blocked_address' FROM p""")
def webhook_approvals(spark, sf):
    approvers = spark.createDataFrame([("bob", "webhook", bytearray(KEY), "https://bob.example.com/"), ("carol", "webhook", None, "https://open.example.com/"), ("dave", "webhook", None, "https://10.0.0.1/"), ("alice", "crypto", bytearray(KEY), None)], "approver_id string, mode string, shared_secret binary, webhook_url string")
    return services.ask_webhooks(facade.payments(spark, sf), approvers, _approver_service, wait=0.0).select("payment_id", "approver_id", "approved", "reason")


def _signer():
    def sign(payment: dict) -> str:
        if payment["payment_id"] % 10 == 0:
            raise RuntimeError("no funds")
        return f"{payment['pay_to']}:{payment['amount']}"

    return sign


@query("SELECT event_id AS payment_id, CASE WHEN value <= 100 AND event_id % 10 <> 0 THEN '0x' || (user_id % 7) || ':' || value END AS token, CASE WHEN value <= 100 AND event_id % 10 = 0 THEN 'RuntimeError: no funds' END AS signing_error FROM events")
def signed_payments(spark, sf):
    return services.sign(facade.payments(spark, sf), _signer, F.col("amount_usd") <= 100).select("payment_id", "token", "signing_error")


def _server():
    """A stand-in for a server: some pages cost something, which the payment's token settles."""

    def get(url: str, body: bytes, headers: dict[str, str]):
        n = int(url.rpartition("/")[2])
        if n % 7 == 0:
            return 500, {}, b""
        if n % 3 == 0 and headers.get("X-PAYMENT") != f"0x{n % 7}:0.{n % 9}":
            offer = {"scheme": "exact", "network": "base", "maxAmountRequired": f"0.{n % 9}", "resource": url, "payTo": f"0x{n % 7}"}
            return 402, {"x-payment": json.dumps({"accepts": [offer] if n % 5 else []})}, b"pay first"
        return 200, {}, f"page {n}".encode()

    return get


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unavailable' WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'no_offers' WHEN event_id % 3 = 0 AND event_id % 10 = 0 THEN 'RuntimeError: no funds' END AS error,
 CASE WHEN event_id % 7 <> 0 AND (event_id % 3 <> 0 OR event_id % 5 <> 0) THEN 'page ' || event_id END AS body FROM events""")
def paid_requests(spark, sf):
    """A client's round: ask, read the offer, sign, ask again with the token."""
    asked = facade.table(spark, sf, "events").select("event_id", F.concat(F.lit("https://shop.example.com/"), "event_id").alias("url"))
    first = services.fetch(asked, _server, wait=0.0)
    due = payments.payment_requests(first).select("event_id", "url", payments.parse_header(F.col("x_payment")).alias("h")).select("event_id", "url", "h.*").withColumn("payment_id", F.col("event_id"))
    signed = services.sign(due, _signer, F.col("header_error").isNull())
    paid = services.fetch(signed.select("event_id", F.when(F.col("token").isNotNull(), F.col("url")).alias("url"), "header_error", "signing_error", "token"), _server, token="token", wait=0.0)
    paid = paid.select("event_id", F.coalesce("header_error", "signing_error", "error").alias("error"), "body")
    free = first.where("http_status is null or http_status <> 402").select("event_id", "error", "body")
    return free.unionByName(paid)


# ---------------------------------------------------------------- audit


@query(f"""WITH {AUDIT_SQL} SELECT agent_id, count(*) FILTER (event_type = 'PAYMENT_ALLOWED') AS allowed, count(*) FILTER (event_type = 'PII_REDACTED') AS pii_redacted, count(*) FILTER (event_type = 'PII_BLOCKED') AS pii_blocked,
 count(*) FILTER (event_type = 'POLICY_BLOCKED') AS policy_blocked, count(*) FILTER (event_type = 'REPLAY_BLOCKED') AS replay_blocked, count(*) FILTER (event_type = 'PAYMENT_ERROR') AS errors,
 round(coalesce(sum(amount_usd) FILTER (event_type = 'PAYMENT_ALLOWED'), 0), 4) AS total_usd FROM a GROUP BY 1""")
def agent_summaries(spark, sf):
    return audit.agent_summaries(facade.audit(spark, sf)).withColumn("total_usd", F.round("total_usd", 4))


@query(f"WITH {AUDIT_SQL} SELECT u.entity_type, count(*) AS n FROM a, unnest(a.pii) AS u(entity_type) GROUP BY 1")
def entity_counts(spark, sf):
    return audit.entity_counts(facade.audit(spark, sf))


@query(f"WITH {AUDIT_SQL} SELECT count(*) AS events, count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER (outcome = 'allowed') AS allowed, round(sum(amount_usd) FILTER (event_type = 'PAYMENT_ALLOWED'), 4) AS total_spend_usd FROM a")
def totals(spark, sf):
    return audit.totals(facade.audit(spark, sf)).withColumn("total_spend_usd", F.round("total_spend_usd", 4))


@query(f"WITH {AUDIT_SQL} SELECT seq, event_type, outcome FROM a WHERE agent_id = '7'")
def entries_for_agent(spark, sf):
    return audit.entries_for_agent(facade.audit(spark, sf), "7").select("seq", "event_type", "outcome")


def _logged(spark, sf):
    e = facade.audit(spark, sf)
    return audit.chain(e.select("agent_id", "seq", F.to_json(F.struct("event_type", "agent_id")).alias("body")), KEY)


CHAIN_SQL = f"""
WITH RECURSIVE {AUDIT_SQL}, o AS (SELECT agent_id, seq, event_type, row_number() OVER (PARTITION BY agent_id ORDER BY seq) AS n FROM a),
s AS (SELECT agent_id, seq, n, NULL::VARCHAR AS prev_entry_hmac, '{{"event_type": "' || event_type || '", "agent_id": "' || agent_id || '", "prev_entry_hmac": null}}' AS raw FROM o WHERE n = 1
 UNION ALL SELECT agent_id, seq, n, h, '{{"event_type": "' || event_type || '", "agent_id": "' || agent_id || '", "prev_entry_hmac": "' || h || '"}}' FROM (SELECT o.*, {hmac_sql('s.raw')} AS h FROM s JOIN o ON o.agent_id = s.agent_id AND o.n = s.n + 1))
"""


@query(CHAIN_SQL + "SELECT agent_id, seq, prev_entry_hmac FROM s")
def audit_chain(spark, sf):
    return _logged(spark, sf).select("agent_id", "seq", "prev_entry_hmac")


@query(f"WITH {AUDIT_SQL}, n AS (SELECT seq, agent_id, lag(seq % 10 = 0) OVER (PARTITION BY agent_id ORDER BY seq) AS hit FROM a) SELECT agent_id, seq, NOT coalesce(hit, false) AS chain_ok FROM n")
def audit_chain_check(spark, sf):
    lines = _logged(spark, sf).withColumn("raw", F.when(F.col("seq") % 10 == 0, F.replace("raw", F.lit("agent_id"), F.lit("agent_iD"))).otherwise(F.col("raw")))
    return audit.check_chain(lines, KEY).select("agent_id", "seq", "chain_ok")


@query(f"""WITH {AUDIT_SQL}, c AS (SELECT 'payments_total' AS metric, outcome AS label_a, CASE event_type WHEN 'POLICY_BLOCKED' THEN 'policy' WHEN 'REPLAY_BLOCKED' THEN 'replay' ELSE '' END AS label_b FROM a
 UNION ALL SELECT 'policy_violations_total', 'limit_exceeded', '' FROM a WHERE event_type = 'POLICY_BLOCKED' UNION ALL SELECT 'replay_detections_total', '', '' FROM a WHERE event_type = 'REPLAY_BLOCKED'
 UNION ALL SELECT 'pii_detections_total', u.x, 'redact' FROM a, unnest(a.pii) AS u(x)) SELECT metric, label_a, label_b, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def metrics_counters(spark, sf):
    t = F.col("event_type")
    return audit.counters(facade.audit(spark, sf), F.when(t == "POLICY_BLOCKED", "policy").when(t == "REPLAY_BLOCKED", "replay").otherwise(""))


@query("WITH b AS (SELECT unnest([0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 50.0]::DOUBLE[]) AS e) SELECT e::VARCHAR AS le, (SELECT count(*) FROM events WHERE value <= e) AS n, NULL::DOUBLE AS total FROM b UNION ALL SELECT '+Inf', count(value), round(sum(value), 4) FROM events")
def amount_histogram(spark, sf):
    return audit.histogram(facade.table(spark, sf, "events"), "value").withColumn("total", F.round("total", 4))


@query()
def metrics_text(spark, sf):
    """The decisions' metrics as scrapers read them."""
    d = _decided(spark, sf)
    return audit.exposition(pipeline.metrics(d), audit.histogram(d, "amount_usd"))


# ---------------------------------------------------------------- evaluation


@query(
    "WITH s AS (SELECT l.toxic = 1 AS t, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in RE2.values()) + " AS p FROM documents JOIN labels l USING (doc_id)), c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM s), "
    "r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM c) SELECT tn, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM r"
)
def detector_confusion(spark, sf):
    d = facade.table(spark, sf, "documents").join(facade.table(spark, sf, "labels"), "doc_id")
    d = d.select("toxic", (F.size(detect(normalise(F.col("text")))) > 0).alias("any"))
    out = evaluation.sample_report(d, F.col("toxic") == 1, F.col("any"))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def _corpus(spark, sf):
    """A labelled corpus with a sample per event."""
    return corpus.generate(spark, facade.table(spark, sf, "events").count())


def _shares(total: str, names: list[str], shares: list[int], x: str) -> str:
    ends = [sum(shares[: i + 1]) for i in range(len(shares))]
    return "CASE " + " ".join(f"WHEN {x} < {total} * {e} // {ends[-1]} THEN '{n}'" for n, e in zip(names[:-1], ends)) + f" ELSE '{names[-1]}' END"


def corpus_sql() -> str:
    """CTEs up to corpus_rows(id, category, q) and corpus_labels(id, place, field, u, entity_type): the corpus's arithmetic over as many rows as events has."""
    cats, (p1, p2, p3) = list(corpus.CATEGORIES.items()), corpus.PRIMES
    k = [f"round_even(n * {w}, 0)::BIGINT" for _, w in cats[:-1]]
    k.append(f"n - ({' + '.join(k)})")
    size = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS category, {x} AS k, {'0' if i == len(k) - 1 else f'round_even(({x}) * 0.4, 0)::BIGINT'} AS p FROM n" for i, ((c, _), x) in enumerate(zip(cats, k)))
    places = ["+".join(f) for f in corpus.PLACES]
    single = f"(pos * {sum(v for f, v in corpus.PLACES.items() if len(f) == 1)} // {sum(corpus.PLACES.values())})"
    return f"""n AS (SELECT count(*) AS n FROM events), sizes AS ({size}),
ranges AS (SELECT *, sum(k) OVER w - k AS k0, sum(p) OVER w - p AS p0 FROM sizes WINDOW w AS (ORDER BY i)), tot AS (SELECT sum(p)::BIGINT AS pos FROM sizes),
slots AS (SELECT id, (id * {p1} + 42) % (SELECT n FROM n) AS slot FROM (SELECT unnest(range((SELECT n FROM n))) AS id)),
corpus_rows AS (SELECT id, category, CASE WHEN slot < k0 + p THEN ((slot - k0 + p0)::BIGINT * {p2} + 42) % pos END AS q, pos FROM slots JOIN ranges ON slot >= k0 AND slot < k0 + k, tot),
placed AS (SELECT id, q, pos, {single} AS one, {_shares('pos', places, list(corpus.PLACES.values()), 'q')} AS place FROM corpus_rows WHERE q IS NOT NULL),
spread AS (SELECT id, one, pos, CASE WHEN q < one THEN q ELSE one + 2 * (q - one) END AS first, unnest(string_split(place, '+')) AS field, generate_subscripts(string_split(place, '+'), 1) - 1 AS j FROM placed),
numbered AS (SELECT id, field, ((first + j) * {p3} + 42) % (one + 2 * (pos - one)) AS u, one + 2 * (pos - one) AS total FROM spread),
corpus_labels AS (SELECT id, field, u, total, {_shares('total', list(corpus.ENTITIES), list(corpus.ENTITIES.values()), 'u')} AS entity_type FROM numbered)"""


FORMS_SQL = "forms(entity_type, f, t) AS (VALUES " + ", ".join(f"('{t}', {i}, '{fixed_point(x)}')" for t, fs in corpus.FORMS.items() for i, (_, x) in enumerate(fs)) + ")"
FOUND_SQL = "found AS (SELECT l.id, l.entity_type, [" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{k}' END" for k, p in RE2.items()) + "] AS hit FROM corpus_labels l JOIN forms ON forms.entity_type = l.entity_type AND f = u % 5)"
SCORE_SQL = "coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall"


@query(f"""WITH {corpus_sql()}, {FORMS_SQL}, {FOUND_SQL},
o AS (SELECT entity_type, CASE WHEN list_contains(hit, entity_type) THEN 'tp' ELSE 'fn' END AS kind FROM found UNION ALL SELECT x, 'fp' FROM (SELECT entity_type, unnest(hit) AS x FROM found) WHERE x IS NOT NULL AND x <> entity_type),
c AS (SELECT entity_type, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn FROM o GROUP BY ROLLUP (entity_type)), r AS (SELECT *, {SCORE_SQL} FROM c)
SELECT entity_type, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM r""")
def entity_confusion(spark, sf):
    c = evaluation.normalised(_corpus(spark, sf))
    out = evaluation.by_f1(evaluation.entity_report(c.withColumn("predictions", evaluation.predictions(c))))
    return out.withColumns({x: F.round(x, 9) for x in ("precision", "recall", "f1")})


CONFIGS_SQL = "cfg(i, types) AS (VALUES " + ", ".join(f"({i}, [{', '.join(repr(t) for t in sorted(types))}])" for i, (_, types, _) in enumerate(evaluation.configurations())) + ")"


@query(f"""WITH {corpus_sql()}, {FORMS_SQL}, {FOUND_SQL}, {CONFIGS_SQL},
h AS (SELECT i, types, id, entity_type, list_filter(hit, lambda x: list_contains(types, x)) AS hit FROM found, cfg),
e AS (SELECT i, count(*) FILTER (list_contains(hit, entity_type)) AS tp, sum(len(list_filter(hit, lambda x: x <> entity_type)))::BIGINT AS fp, count(*) FILTER (NOT list_contains(hit, entity_type)) AS fn FROM h GROUP BY 1),
s AS (SELECT i, id, bool_or(len(hit) > 0) AS b0 FROM h GROUP BY 1, 2), b AS (SELECT i, count(*) FILTER (b0) AS sample_tp, count(*) FILTER (NOT b0) AS sample_fn FROM s GROUP BY 1),
r AS (SELECT e.*, sample_tp, 0::BIGINT AS sample_fp, sample_fn, (SELECT n FROM n) - sample_tp - sample_fn AS sample_tn, {SCORE_SQL}, CASE WHEN sample_tp > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS sp, sample_tp::DOUBLE / (sample_tp + sample_fn) AS sr FROM e JOIN b USING (i))
SELECT 'patterns' AS mode, types AS entities, 0.5::DOUBLE AS min_score, (SELECT n FROM n) AS n_samples, sample_tp, sample_fp, sample_fn, sample_tn, tp, fp, fn, round(precision, 4) AS micro_precision, round(recall, 4) AS micro_recall,
 round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 4) AS micro_f1, round(sp, 4) AS sample_precision, round(sr, 4) AS sample_recall, round(coalesce(2 * sp * sr / nullif(sp + sr, 0), 0), 4) AS sample_f1 FROM r JOIN cfg USING (i)""")
def sweep_scores(spark, sf):
    return evaluation.sweep_scores(_corpus(spark, sf), evaluation.configurations())


@query("SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events")
def latency_percentiles(spark, sf):
    return evaluation.percentiles(facade.table(spark, sf, "events"), "value").withColumn("mean", F.round("mean", 6))


@query(f"""WITH {corpus_sql()}, t AS (SELECT (SELECT n FROM n) AS n, (SELECT pos FROM tot) AS pos, (SELECT count(*) FROM corpus_labels) AS ent)
SELECT 'n_total' AS metric, '' AS label, n, NULL::DOUBLE AS rate FROM t UNION ALL SELECT 'n_positive', '', pos, round_even(pos::DOUBLE / n, 4)::DOUBLE FROM t UNION ALL SELECT 'n_negative', '', n - pos, NULL FROM t UNION ALL SELECT 'n_entities', '', ent, NULL FROM t
UNION ALL SELECT 'category', category, count(*), NULL FROM corpus_rows GROUP BY category UNION ALL SELECT 'field', field, count(*), NULL FROM corpus_labels GROUP BY field
UNION ALL SELECT 'entity_type', entity_type, count(*), round_even(count(*)::DOUBLE / (SELECT ent FROM t), 4)::DOUBLE FROM corpus_labels GROUP BY entity_type""")
def corpus_meta(spark, sf):
    return evaluation.corpus_meta(_corpus(spark, sf))


@query("SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) AS origin, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS base FROM pages")
def origin_extract(spark, sf):
    return facade.table(spark, sf, "pages").select("page_id", urls.origin(F.col("url")).alias("origin"), urls.base(F.col("url")).alias("base"))


@query(f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{RE2["IP_ADDRESS"]}')) AS ip FROM documents), n AS (SELECT doc_id, ip, string_split(ip, '.')[1]::BIGINT AS a, string_split(ip, '.')[2]::BIGINT AS b FROM m)
SELECT doc_id, ip, a IN (127, 10, 0) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) AS blocked FROM n""")
def cidr_check(spark, sf):
    d = facade.table(spark, sf, "documents").where(F.col("text").rlike("[0-9]"))
    return d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PATTERNS["IP_ADDRESS"]), F.lit(0))).alias("ip")).select("doc_id", "ip", urls.ipv4_blocked(F.col("ip")).alias("blocked"))


@query("""SELECT event_id, CASE WHEN length(props) > 5 THEN substr(props, 1, 5) || '...[truncated]' ELSE props END AS message, CASE WHEN event_id % 2 = 0 THEN greatest(0, event_id - 50) END::INT AS retry_after,
 'user ' || user_id || ' paid' AS filled, len('user ' || user_id) AS filled_end, round_even(value::DECIMAL(12, 2), 1)::DOUBLE AS rounded,
 len('user ') < len('user ' || user_id) AND len('user ' || user_id) > 6 AS overlap FROM events""")
def misc_scalars(spark, sf):
    filled = scalars.inject(F.lit("user {SLOT} paid"), F.col("user_id").cast("string"))
    return facade.table(spark, sf, "events").select(
        "event_id", scalars.safe_message(F.col("props"), 5).alias("message"), scalars.retry_after(F.when(F.col("event_id") % 2 == 0, (F.col("event_id") - 50).cast("string")).otherwise("soon")).alias("retry_after"),
        filled["text"].alias("filled"), filled["end"].cast("long").alias("filled_end"), scalars.round_even(F.col("value"), 1).alias("rounded"), scalars.overlaps(filled["start"], filled["end"], F.lit(6), F.lit(99)).alias("overlap"),
    )


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['US_SSN:reason'] WHEN 1 THEN ['EMAIL_ADDRESS:resource_url', 'EMAIL_ADDRESS:resource_url', 'US_SSN:reason'] WHEN 2 THEN ['EMAIL_ADDRESS:resource_url', 'EMAIL_ADDRESS:resource_url', 'EMAIL_ADDRESS:resource_url', 'EMAIL_ADDRESS:resource_url', 'US_SSN:reason'] ELSE list_concat(list_transform(range(6), lambda i: 'EMAIL_ADDRESS:resource_url'), ['US_SSN:reason']) END AS entities FROM events")
def counted_entities(spark, sf):
    """Entities given with a count, spelled out."""
    one = lambda t, f, n: F.struct(F.lit(t).alias("entity_type"), F.lit(f).alias("field"), n.cast("int").alias("count"))
    found = F.array(one("EMAIL_ADDRESS", "resource_url", F.col("event_id") % 4 * 2), one("US_SSN", "reason", F.lit(1)))
    return facade.table(spark, sf, "events").select("event_id", F.transform(scalars.repeated(found), lambda e: F.concat(e["entity_type"], F.lit(":"), e["field"])).alias("entities"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('day', ts) END AS at FROM events")
def event_times(spark, sf):
    """ISO texts without a zone (UTC), with one, of a date only, and unreadable ones, whose time is now (shown as null)."""
    e, k = facade.table(spark, sf, "events"), F.col("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(k == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("yesterday")
    at = scalars.event_time(text)
    return e.select("event_id", F.when(at < F.current_timestamp(), at).cast("timestamp_ntz").alias("at"))


@query("""WITH u AS (SELECT page_id, url, page_id % 6 AS k FROM pages) SELECT page_id, CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'blocked_address' WHEN 2 THEN 'no_host' WHEN 3 THEN 'not_https' WHEN 4 THEN 'blocked_address' ELSE CASE WHEN NOT starts_with(url, 'https://') THEN 'not_https' END END AS error FROM u""")
def webhook_check(spark, sf):
    p, k = facade.table(spark, sf, "pages"), F.col("page_id") % 6
    url = F.when(k == 0, "").when(k == 1, "https://10.1.2.3:8443/hook").when(k == 2, "https:///hook").when(k == 3, "ftp://example.com/").when(k == 4, "https://[fd00::12]/hook").otherwise(F.col("url"))
    return p.select("page_id", urls.webhook_error(url).alias("error"))


PAYLOAD_SQL = "'{\"agent_id\":\"' || user_id || '\",\"amount_usd\":\"' || printf('%.6f', value) || '\",\"network\":\"base\",\"resource_url\":\"https://x.example.com/\\u00e9/' || user_id || '\"}'"


@query(f"SELECT event_id, {PAYLOAD_SQL} AS payload, {hmac_sql(PAYLOAD_SQL)} AS signature, substr({hmac_sql(PAYLOAD_SQL)}, 1, 16) AS short_id FROM events")
def approval_payload(spark, sf):
    """What approvers sign, in ASCII, and the header that signs a webhook's body."""
    e = facade.table(spark, sf, "events")
    url = F.concat(F.lit("https://x.example.com/\u00e9/"), "user_id")
    e = e.withColumn("payload", crypto.canonical_approval(url, F.col("value"), F.lit("base"), F.col("user_id").cast("string")))
    return e.select("event_id", "payload", crypto.webhook_signature(F.col("payload"), KEY).alias("signature"), crypto.short_id(crypto.hmac_sha256(F.col("payload"), KEY)).alias("short_id"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50)")
def seeded_sample(spark, sf):
    return evaluation.seeded_sample(facade.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 50)
