"""Boundary facts of detection, admission, audit and policy files, and batch against stream."""

import hashlib
import hmac
import json
import math
import random
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from paywarden.functions import crypto, scalars, urls
from paywarden.functions.detect import DETECTORS, PATTERNS, STABLE, detect, entities_of, normalise, redact, register_detector, scan_fields
from paywarden.functions.json_scan import redact_text
from paywarden.operators import admission, audit, evaluation, payments, services
from paywarden.plans import pipeline
from paywarden.plans.registry import KEY, QUERIES
from paywarden.sources import corpus, files

SF = "/root/testdata/sf0.001"
BASE = 1_700_000_000_000_000  # a stream's first watermark is 1970
TEXTS = [
    "write to ines.okafor@example.com", "https://pay.example.org/of/ines.okafor@example.com/now", "her number is 219-45-6789", "no=219456789;", "never 000-12-3456 or 666-12-3456", "pay with 4012888888881881", "5105105105105100",
    "ring 303-555-0171", "(303) 555-0171 or +1 303.555.0171", "", "NL91ABNA0417164300", "from 172.16.4.9 to 9.9.9.9", "in\u0435s@example.com", "ines@exam\u200bple.com", "219\u201345\u20136789", "\u0663\u0661\u0662-\u0664\u0665-\u0666\u0667\u0668\u0669",
    "\U0001f600 jon@example.org \U0001f600 219-45-6789", "\uff2e\uff2c91ABNA0417164300", "\uff49\uff4e\uff45\uff53\uff20example.com", "\uff12\uff11\uff19-\uff14\uff15-\uff16\uff17\uff18\uff19", "caf\u00e9 \u00bd",
]


def test_native_redaction_equals_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("n", normalise(F.col("t"))).withColumn("e", detect(F.col("n")))
    for r in df.select("t", redact(F.col("n"), F.col("e")).alias("clean"), F.transform("e", lambda x: x["entity_type"]).alias("kinds")).collect():
        assert (r.clean, r.kinds) == redact_text(r.t), r.t
    full = {r.t: r.k for r in df.select("t", F.transform("e", lambda x: x["entity_type"]).alias("k")).collect()}
    assert [full[t] for t in TEXTS[17:20]] == [["IBAN_CODE"], ["EMAIL_ADDRESS"], ["US_SSN"]] and full[TEXTS[15]] == []
    null = spark.createDataFrame([(None,)], "t string").select(normalise(F.col("t")).alias("n"), detect(normalise(F.col("t"))).alias("e")).first()
    assert null.n is None and null.e == []


def test_texts_that_skip_nfkc_are_its_fixed_points():
    import re

    stable = re.compile(STABLE.replace("$", r"\Z"))
    assert all(unicodedata.normalize("NFKC", chr(c)) == chr(c) and c < 0x300 for c in range(0x110000) if not 0xD800 <= c < 0xE000 and stable.match(chr(c)))


def test_subsets_and_template(spark):
    df = spark.createDataFrame([("a@b.co 123-45-6789",)], "t string")
    r = df.select(F.size(detect(F.col("t"), [])).alias("none"), detect(F.col("t"), ["EMAIL_ADDRESS"]).alias("one"), redact(F.col("t"), detect(F.col("t")), "[REDACTED:{entity_type}]").alias("x")).first()
    assert r.none == 0 and [e.entity_type for e in r.one] == ["EMAIL_ADDRESS"] and r.x == "[REDACTED:EMAIL_ADDRESS] [REDACTED:US_SSN]"
    assert list(PATTERNS)[0] == "EMAIL_ADDRESS"


def test_detector_plug_and_scores(spark):
    def names(text):
        one = F.struct(F.lit(0).alias("start"), F.lit(9).alias("rank"), F.lit(3).alias("end"), F.lit("PERSON").alias("entity_type"), F.lit("Ada").alias("original_text"), F.lit(0.4).alias("score"))
        return F.filter(F.array(one), lambda e: text.startswith("Ada"))

    register_detector("names", names)
    df = spark.createDataFrame([("Ada pays", "a@b.co")], "x string, y string")
    r = df.select(scan_fields({"x": F.col("x"), "y": F.col("y")}).alias("p"), scan_fields({"x": F.col("x")}, min_score=1.1).alias("none")).first()
    assert [(e.field, e.entity_type, e.score) for e in r.p] == [("y", "EMAIL_ADDRESS", 1.0)] and r.none == []
    assert df.select(F.size(entities_of(scan_fields({"x": F.col("x"), "y": F.col("y")}, "names"), "x"))).first()[0] == 1
    c = corpus.generate(spark, 200)
    got = {(r.mode, r.min_score): r for r in evaluation.sweep_scores(c, [c for c in evaluation.configurations(("patterns", "names")) if len(c[1]) == 6]).collect()}
    assert len(got) == 6 and len(evaluation.configurations(("patterns", "names"))) == 42 and got["names", 0.5].tp == 0
    del DETECTORS["names"]


def test_corpus_totals_and_scores(spark):
    """The totals of the default size, and the scores by plain Python."""
    c = corpus.generate(spark)
    meta = {(r.metric, r.label): r.n for r in evaluation.corpus_meta(c).collect()}
    assert [meta[k, ""] for k in ("n_total", "n_positive", "n_negative", "n_entities")] == [2000, 720, 1280, 875]
    assert {k: meta["entity_type", k] for k in corpus.ENTITIES} == corpus.ENTITIES
    assert [meta["field", k] for k in evaluation.FIELDS] == [396, 248, 231] and meta["category", "medical"] == 300
    rows = c.collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.id)] == [f"syn-{i:05d}" for i in range(2000)]
    assert all(r[x.field][x.start : x.end] == x.original_text for r in rows for x in r.labels)
    counts = {}
    for r in rows:
        found = [(f, k) for f in evaluation.FIELDS for k in redact_text(r[f])[1]]
        for x in r.labels:
            hit = (x.field, x.entity_type) in found
            counts[x.entity_type, "tp" if hit else "fn"] = counts.get((x.entity_type, "tp" if hit else "fn"), 0) + 1
            if hit:
                found.remove((x.field, x.entity_type))
        for _, k in found:
            counts[k, "fp"] = counts.get((k, "fp"), 0) + 1
    n = evaluation.normalised(c)
    got = evaluation.by_f1(evaluation.entity_report(n.withColumn("predictions", evaluation.predictions(n)))).collect()
    assert {(r.entity_type, k): r[k] for r in got for k in ("tp", "fp", "fn") if r.entity_type and r[k]} == counts
    assert [r.f1 for r in got[:-1]] == sorted((r.f1 for r in got[:-1]), reverse=True) and got[-1].entity_type is None


def _pay(spark, rows):
    return spark.createDataFrame(rows, "agent_id long, seq long, s double, amount_usd double, resource_url string").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long") + BASE))


@pytest.mark.parametrize(
    "policy,rows,want",
    [
        (admission.Policy(0.10), [(1, 0.05), (2, 0.10), (3, 0.15)], ["allowed", "allowed", "per_call"]),
        (admission.Policy(None, 0.30), [(1, 0.20), (2, 0.05), (3, 0.10)], ["allowed", "allowed", "daily_limit"]),
        (admission.Policy(None, 0.30), [(i, 0.09) for i in range(4)], ["allowed"] * 3 + ["daily_limit"]),
        (admission.Policy(None, 0.10, {}, 1), [(0, 0.08), (1.1, 0.08)], ["allowed", "allowed"]),
        (admission.Policy(None, None, {"https://premium-api.io": 0.20}), [(0, 0.15), (1, 0.10)], ["allowed", "per_endpoint"]),
        (admission.Policy(None, 0.10, {}, 1), [(0, 0.08), (1, 0.08)], ["allowed", "daily_limit"]),
        (admission.Policy(1.0, 2.0), [(0, 1.0), (1, None), (2, math.nan), (3, math.inf), (4, -1.0), (None, 0.5), (5, 1.0), (6, 0.1)], ["allowed"] + ["invalid_amount"] * 4 + ["invalid_time", "allowed", "daily_limit"]),
    ],
)
def test_budget(spark, policy, rows, want):
    df = _pay(spark, [(1, i, None if s is None else float(s), a, f"https://premium-api.io/{i}") for i, (s, a) in enumerate(rows)])
    assert [r[0] for r in admission.budget_decisions(df, policy).orderBy("seq").select("policy_verdict").collect()] == want


def test_running_totals_decide_as_folds():
    """Sums at the limit, where only the order of additions tells, and long windows."""
    rng = random.Random(1)
    for limit, amounts in ((0.3, (0.1, 0.2, 0.05)), (1.0, (0.1, 0.3, 0.7)), (5e15, (1e15, 0.3, 1e-3)), (100.0, (0.01, 0.07))):
        ledger, rows = admission.Ledger(), []
        for now in range(600):
            x, now = rng.choice(amounts), now * 10
            rows = [r for r in rows if r[0] >= now - 900]
            total = 0.0
            for _, v in rows:
                total += v
            assert ledger.exceeds(now, 900, x, limit) == (total + x > limit)
            if total + x <= limit:
                rows.append((now, x))
                ledger.record(now, x)


def _stream(spark, df, make, tmp_path, name, batches=1):
    """Rows that a stream operator gives for df, fed in `batches` files by seq."""
    rows = sorted(df.collect(), key=lambda r: r.seq)
    for i in range(batches):
        spark.createDataFrame(rows[i * len(rows) // batches : (i + 1) * len(rows) // batches], df.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:02d}"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = make(src).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return spark.table(name).collect()


@pytest.mark.parametrize("watermark", [None, "1 second"])
def test_replay_batch_and_stream(spark, tmp_path, watermark):
    rows = [("a", 0, 0.0), ("a", 1, 200.0), ("a", 2, 400.0), ("b", 3, 450.0), ("a", 4, 700.0), ("b", 5, 750.0), ("c", 6, 2000.0), ("a", 7, 2000.5)]
    df = spark.createDataFrame(rows, "replay_fingerprint string, seq long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long") + BASE)).drop("s")
    want = {0: True, 1: False, 2: True, 3: True, 4: True, 5: True, 6: True, 7: True}
    assert {r.seq: r.replay_ok for r in admission.replay_decisions(df, 300).collect()} == want
    from paywarden.streaming.processors import replay_stream

    got = _stream(spark, df, lambda s: replay_stream(s, 300, watermark), tmp_path, f"replays_{watermark is None}", 4)
    assert {r.seq: r.replay_ok for r in got} == want
    none = df.withColumn("ts", F.lit(None).cast("timestamp"))
    assert [r.replay_ok for r in admission.replay_decisions(none, 300).collect()] == [False] * len(rows)


@pytest.mark.parametrize("watermark", [None, "5 minutes"])
def test_budget_batch_and_stream(spark, tmp_path, watermark):
    from paywarden.streaming.processors import budget_stream

    rng = random.Random(3)
    policy = admission.Policy(0.9, 2.0, {"https://p.example": 1.2}, 60)
    rows = [(rng.randrange(3), i, i * 4.0, rng.choice([0.1, 0.4, 0.8, 1.0, None, math.nan, -2.0]), rng.choice(["https://p.example/x", "https://q.example"])) for i in range(120)]
    df = _pay(spark, rows)
    want = {r.seq: (r.policy_verdict, r.policy_limit_usd) for r in admission.budget_decisions(df, policy).collect()}
    live = df.withColumn("endpoint", urls.longest_prefix(F.col("resource_url"), list(policy.per_endpoint))).select("agent_id", "seq", "ts", "amount_usd", "endpoint")
    got = _stream(spark, live, lambda s: budget_stream(s, policy, watermark), tmp_path, f"budgets_{watermark is None}", 6)
    assert {r.seq: (r.policy_verdict, r.policy_limit_usd) for r in got} == want and len(set(want.values())) == 5


def test_chain_batch_stream_and_writers(spark, tmp_path):
    from paywarden.streaming import processors

    bodies = [(f"a{i % 2}", i, json.dumps({"n": i, "t": "caf\u00e9"}) if i % 5 else [None, "not json", "[1]"][i // 5 % 3]) for i in range(20)]
    df = spark.createDataFrame(bodies, "agent_id string, seq long, body string").withColumn("ts", F.timestamp_seconds("seq"))
    batch = {r.seq: (r.prev_entry_hmac, r.raw) for r in audit.chain(df, KEY).collect()}
    prev, want = {}, {}
    for agent, seq, body in bodies:
        want[seq] = (None, None)
        if body and body.startswith("{"):
            raw = json.dumps({**json.loads(body), "prev_entry_hmac": prev.get(agent)})
            want[seq] = (prev.get(agent), raw)
            prev[agent] = hmac.new(KEY, raw.encode(), hashlib.sha256).hexdigest()
    assert batch == want
    got = _stream(spark, df, lambda s: processors.chain_stream(s, KEY), tmp_path, "chains", 3)
    assert {r.seq: (r.prev_entry_hmac, r.raw) for r in got} == want
    lines = audit.chain(df, KEY).where("raw is not null")
    assert all(r.chain_ok for r in audit.check_chain(lines, KEY).collect())
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*"))
    q = processors.write_audit(processors.chain_stream(src, KEY), "files", str(tmp_path / "log"), str(tmp_path / "cp2"))
    assert q.awaitTermination(120) and q.exception() is None
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).where("value <> ''").collect()) == sorted(raw for _, raw in want.values() if raw)
    seen = []
    processors.register_writer("broken", lambda batch, to: seen.append(batch.count()) or 1 / 0)
    q = processors.write_audit(processors.chain_stream(src, KEY), "broken", "", str(tmp_path / "cp3"))
    assert q.awaitTermination(120) and q.exception() is None and seen == [20]
    processors.reset(spark, str(tmp_path / "cp3"))
    assert not (tmp_path / "cp3").exists()


def test_quorum_stream(spark, tmp_path):
    """Signatures at once, webhooks in time, refusals, and a timer where an answer is missing; the same by batch."""
    from paywarden.streaming.processors import quorum_stream

    secret, body = b"k" * 100, "pay"
    good = hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()
    ask, sign, web = (lambda p, t: (p, t, None, None, None)), (lambda p, t, ok: (p, t, "alice", good if ok else "00", None)), (lambda p, t, who, ok: (p, t, who, None, ok))
    rows = [
        ask(1, 0), sign(1, 1, True), web(1, 2, "bob", True), web(1, 3, "carol", False), ask(2, 10), sign(2, 11, False), web(2, 12, "bob", True), web(2, 13, "carol", True), ask(3, 20), web(3, 21, "bob", True), web(3, 90, "carol", True),
        ask(4, 30), web(4, 31, "bob", False), web(4, 32, "carol", True), web(4, 33, "mallory", True), ask(5, 40), sign(5, 41, True), ask(6, 300), web(6, 301, "bob", True), web(6, 302, "carol", True), ask(7, 5000),
    ]
    schema = "payment_id long, ts timestamp, approver_id string, signature string, approved boolean, seq long, body string"
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "payment_id long, t long, approver_id string, signature string, approved boolean, seq long")
    df = df.select("payment_id", F.timestamp_seconds(F.col("t") + BASE // 1_000_000).alias("ts"), "approver_id", "signature", "approved", "seq", F.lit(body).alias("body"))
    assert [f.split()[0] for f in schema.split(", ")] == df.columns
    approvers = spark.createDataFrame([("alice", "crypto", bytearray(secret)), ("bob", "webhook", None), ("carol", "webhook", None)], "approver_id string, mode string, shared_secret binary")
    want = {1: "approved", 2: "approved", 3: "timeout", 4: "denied", 5: "timeout", 6: "approved"}
    got = _stream(spark, df, lambda s: quorum_stream(s, approvers, 2, 60.0, "1 second"), tmp_path, "quorums", 5)
    assert {r.payment_id: r.mpa_verdict for r in got} == want and len(got) == 6
    asked = df.where("approver_id is null and payment_id < 7").select("payment_id", "ts", F.lit(9.0).alias("amount_usd"), "body")
    batch = admission.quorum(asked, df.where("approver_id is not null").drop("body"), approvers, 2, 1.0, F.col("body"), 60.0)
    assert {r.payment_id: r.mpa_verdict for r in batch.collect()} == want


def test_hmac_of_any_key(spark):
    keys = [b"", b"k", b"k" * 64, b"k" * 65, bytes(range(256))]
    df = spark.createDataFrame([(bytearray(k), "m\u00e9ssage") for k in keys], "k binary, m string")
    inner, outer = crypto.hmac_pads(F.col("k"))
    rows = df.select("k", "m", inner.alias("i"), outer.alias("o")).select("k", crypto.hmac_padded(F.col("m"), F.col("i"), F.col("o")).alias("h")).collect()
    assert all(r.h == hmac.new(bytes(r.k), "m\u00e9ssage".encode(), hashlib.sha256).hexdigest() for r in rows)


def test_decisions_by_action(spark):
    rows = [(1, "a", "https://x.example/a@b.co", None, "none", "{}"), (2, "a", "https://x.example", "ssn \uff1119-45-6789", None, '{"a":["x@y.org"]}'), (3, None, "https://x.example", "", "", None), (4, "a", "https://x.example/4", "", "", "not json a@b.co")]
    p = spark.createDataFrame(rows, "payment_id long, a string, resource_url string, description string, reason string, extra string").withColumns(
        {"agent_id": F.lit(1).cast("long"), "seq": F.col("payment_id"), "ts": F.when(F.col("a").isNotNull(), F.timestamp_seconds("payment_id")), "pay_to": F.lit("0x1"), "amount": F.lit("1.5"), "currency": F.lit("usdc"), "network": F.lit("base"), "deadline_seconds": F.lit(300)}
    )
    none = spark.createDataFrame([], "payment_id long, approver_id string, signature string, approved boolean"), spark.createDataFrame([], "approver_id string, mode string, shared_secret binary")
    trusted = spark.createDataFrame([], "origin string, wallet string")
    for action, verdicts in (("redact", ["allowed"] * 2), ("block", ["pii_blocked"] * 2), ("warn", ["allowed"] * 2)):
        got = {r.payment_id: r for r in pipeline.decide(p, admission.Policy(2.0), trusted, KEY, *none, threshold=0, pii_action=action).collect()}
        assert [got[i].verdict for i in (1, 2, 3, 4)] == [*verdicts, "payment_error", "allowed"] and got[3].error == "invalid_time"
        assert got[1].pii_types == ["EMAIL_ADDRESS"] and got[2].pii_entities == ["US_SSN", "EMAIL_ADDRESS"]
        assert got[1].clean_resource_url == "https://x.example/<REDACTED>" and got[2].clean_extra == '{"a":["<REDACTED>"]}' and got[4].clean_extra == "not json a@b.co"
    d = pipeline.decide(p, admission.Policy(1.0), trusted, KEY, *none, threshold=0)
    ev = [(r.payment_id, r.n, r.event_type, r.policy_limit_usd, r.error_message) for r in pipeline.audit_events(d).orderBy("payment_id", "n").collect()]
    assert ev[:3] == [(1, 0, "PII_REDACTED", None, None), (1, 1, "POLICY_BLOCKED", 1.0, "limit exceeded"), (2, 0, "PII_REDACTED", None, None)] and ev[4] == (3, 0, "PAYMENT_ERROR", None, "payment cannot be read: invalid_time")
    with pytest.raises(ValueError):
        pipeline.decide(p, admission.Policy(), trusted, KEY, *none, pii_action="ignore")


def test_metrics_text(spark):
    counts = spark.createDataFrame([("payments_total", "allowed", "none", 3), ("payments_total", "blocked", 'a"b\\', 1), ("replay_detections_total", "", "", 2)], "metric string, label_a string, label_b string, n long")
    amounts = audit.histogram(spark.createDataFrame([(0.5,), (2.0,), (None,), (99.0,)], "v double"), "v")
    text = [r.line for r in audit.exposition(counts, amounts, "pw").orderBy("no").collect()]
    assert 'pw_payments_total{outcome="allowed",reason="none"} 3' in text and 'pw_payments_total{outcome="blocked",reason="a\\"b\\\\"} 1' in text and "pw_replay_detections_total 2" in text
    at = text.index("# TYPE pw_payment_amount_usd histogram")
    assert text[at - 1].startswith("# HELP") and text[at + 1].endswith('le="0.001"} 0') and text[at + 10].endswith('le="50.0"} 2') and text[at + 11] == 'pw_payment_amount_usd_bucket{le="+Inf"} 3'
    assert text[at + 12 : at + 14] == ["pw_payment_amount_usd_count 3", "pw_payment_amount_usd_sum 101.5"]


def test_amounts(spark):
    bad = spark.createDataFrame([(x,) for x in ("nan", "NaN", "inf", "-inf", "Infinity", "-1.0", "0.01d", None, "")], "a string")
    assert bad.where(scalars.amount_usd(F.col("a"), F.lit("USDC")).isNotNull()).count() == 0


def test_headers(spark):
    df = spark.createDataFrame([("{",), ("{}",), ('{"accepts":[{"scheme":"exact","resource":"r","network":"n","maxAmountRequired":"1"}]}',)], "h string")
    assert [r[0] for r in df.select(payments.parse_header(F.col("h"))["header_error"]).collect()] == ["invalid_json", "no_offers", "missing_payTo"]


def test_webhooks(spark):
    blocked = ["127.9.9.9", "10.255.0.1", "172.31.255.254", "192.168.77.1", "169.254.0.9", "100.127.0.1", "0.1.2.3", "[::1]", "[fd12::9]", "[febf::1]"]
    df = spark.createDataFrame([(f"https://{h}/x",) for h in [*blocked, "172.32.0.1", "9.9.9.9", "calls.example.org"]], "u string")
    assert [r[0] for r in df.select(urls.webhook_error(F.col("u"))).collect()] == ["blocked_address"] * 10 + [None] * 3


def test_log_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"event_type":"PAYMENT_ALLOWED","amount_usd":0.05,"outcome":"allowed","agent_id":"x","timestamp":"2024-05-01T02:00:00+02:00"}\n\n{"outcome":"blocked"}\n')
    df = files.read_audit_log(spark, str(tmp_path / "a.jsonl"))
    assert [(r.seq, r.event_type) for r in df.orderBy("seq").collect()] == [(1, "PAYMENT_ALLOWED"), (3, "UNKNOWN")]
    assert df.orderBy("seq").select(F.date_format("timestamp", "yyyy-MM-dd HH:mm")).first()[0] == "2024-05-01 00:00"
    rep = audit.report(df)
    assert rep["allowed"] == 1 and rep["blocked"] == 1 and abs(rep["total_spend_usd"] - 0.05) < 1e-9 and "intact" in audit.summary(rep)
    files.save_report(spark, rep, f"file://{tmp_path}/out/report.json")
    assert json.loads((tmp_path / "out/report.json").read_text())["events"] == 2
    audit.write_report(df, str(tmp_path / "tables"))
    assert {r.agent_id for r in spark.read.json(str(tmp_path / "tables/agents")).collect()} == {"x", None}
    (tmp_path / "b.jsonl").write_text("{}\nnot json\n")
    with pytest.raises(Exception, match="line 2"):
        files.read_audit_log(spark, str(tmp_path / "b.jsonl")).collect()


def test_events_corpora_and_sinks(spark, tmp_path):
    ev = files.events_frame(spark, [{"event_type": "PII_REDACTED", "agent_id": "b", "pii_entities_found": ["US_SSN"]}, {"event_type": "PAYMENT_ALLOWED", "agent_id": "a", "amount_usd": 2.0, "outcome": "allowed"}])
    rep = audit.report(ev)
    assert rep["chain_ok"] and rep["pii_entities"] == {"US_SSN": 1} and [a["agent_id"] for a in rep["agents"]] == ["a", "b"]
    c = corpus.generate(spark, 60)
    files.write_json(c, str(tmp_path / "c"))
    assert sorted(files.read_corpus(spark, str(tmp_path / "c")).collect()) == sorted(c.collect())
    files.write_json(evaluation.sweep_scores(c, evaluation.configurations()), str(tmp_path / "sweep"))
    assert spark.read.json(str(tmp_path / "sweep")).count() == 7
    for _ in range(2):
        files.write_lines(audit.chain(ev.select("agent_id", F.lit(1).alias("seq"), F.lit("{}").alias("body")), KEY), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 4
    files.discard(c)
    times = [random.Random(7).random() for _ in range(201)]
    p = evaluation.percentiles(spark.createDataFrame([(t,) for t in times], "v double"), "v")
    files.write_json(p, str(tmp_path / "latency"))
    assert abs(spark.read.json(str(tmp_path / "latency")).first().p50 - statistics.median(times)) < 1e-12


def test_services_repeat_once_and_stop_what_is_unsafe(spark):
    def flaky():  # within the test, so that it is pickled by value
        seen = {}

        def post(url, body, headers):
            seen[url] = seen.get(url, 0) + 1
            if url == "down":
                raise ConnectionError
            status = 500 if url.startswith("http-") else 503 if seen[url] == 1 else 200
            return status, {}, str(seen[url]).encode()

        return post

    df = spark.createDataFrame([("https://a",), ("http-500",), ("down",), (None,)], "u string").coalesce(1)
    asked = {r.u: (r.error, r.status, r.body) for r in services.call(df, flaky, F.col("u"), F.lit("x"), wait=0.0).collect()}
    assert asked == {"https://a": (None, 200, "2"), "http-500": ("unavailable", 500, None), "down": ("unreachable", None, None), None: (None, None, None)}
    with pytest.raises(ValueError):
        services.remote_screen(df, flaky, "http://screen.example.com", "key")


def test_keys_from_configuration(spark):
    spark.conf.set("spark.paywarden.test.key", "00ff" * 16)
    assert files.key_from_conf(spark, "spark.paywarden.test.key", exact=32) == b"\x00\xff" * 16
    for name, value in (("spark.paywarden.test.short", "00ff"), ("spark.paywarden.test.bad", "zz" * 32)):
        spark.conf.set(name, value)
        with pytest.raises(ValueError):
            files.key_from_conf(spark, name)
    with pytest.raises(ValueError):
        files.key_from_conf(spark, "spark.paywarden.test.unset")


def test_policy_files(tmp_path):
    assert files.validate_policy({"max_per_call_usd": 1, "mpa": {"threshold": 1, "approvers": [{"approver_id": "a", "mode": "webhook"}]}}) == []
    bad = {"max_per_call_usd": -1, "window_seconds": 0, "x": 1, "mpa": {"threshold": 1, "approvers": []}}
    assert [p for p, _ in files.validate_policy(bad)] == ["max_per_call_usd", "mpa/approvers", "window_seconds", "x"]
    (tmp_path / "p.toml").write_text("daily_limit_usd = 2.5\n")
    assert files.load_policy(str(tmp_path / "p.toml")).daily_limit_usd == 2.5


def test_full_sweep_has_all_types(spark):
    got = {r.config: (r.texts_with_any, r.entities) for r in QUERIES["pii_full_sweep"](spark, SF).collect()}
    kinds = [redact_text(r.text)[1] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()]
    assert len(got) == 7 and got["all"] == (sum(map(bool, kinds)), sum(map(len, kinds))) and got["all"][1] > 0


def test_shuffle_keeps_all_rows(spark):
    df = spark.range(100)
    a, b = ([r.id for r in evaluation.shuffled(df, "id", s).collect()] for s in (1, 2))
    assert sorted(a) == sorted(b) == list(range(100)) and a != b and a == [r.id for r in evaluation.shuffled(df.repartition(3), "id", 1).collect()]
