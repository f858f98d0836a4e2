"""File sources and sinks: audit logs, corpora, policy files, reports."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crypto import load_key
from ..functions.scalars import event_time

AUDIT = "timestamp string, event_type string, resource_url string, amount_usd double, network string, agent_id string, outcome string, pii_entities_found array<string>, policy_limit_usd double, replay_fingerprint string, error_message string, prev_entry_hmac string"
CORPUS = "id string, category string, resource_url string, description string, reason string, pii_positive boolean, labels array<struct<field:string,entity_type:string,start:int,`end`:int,original_text:string,surface_form:string>>"
DEFAULTS = {"event_type": "UNKNOWN", "resource_url": "", "amount_usd": 0.0, "network": "", "outcome": ""}


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit events of JSONL files with log (the file), seq (the line's number from 1) and raw.

    Blank lines are skipped but counted; a line that is no JSON object fails the query and says its number. Line
    numbers need a file read as one value, so logs are files of moderate size, each a task's.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log"), F.posexplode(F.split("value", "\r?\n")).alias("seq", "raw"))
    lines = lines.withColumn("seq", F.col("seq") + 1).where(F.trim("raw") != "")
    broken = F.raise_error(F.concat(F.lit("Invalid JSON on line "), F.col("seq").cast("string")))
    valid = F.try_parse_json("raw").isNotNull() & F.trim("raw").startswith("{")
    lines = lines.withColumn("e", F.from_json(F.when(valid, F.col("raw")).otherwise(broken), AUDIT))
    fields = [x.split()[0] for x in AUDIT.split(", ")]
    cols = [F.coalesce(F.col(f"e.{f}"), F.lit(DEFAULTS[f])).alias(f) if f in DEFAULTS else F.col(f"e.{f}").alias(f) for f in fields]
    out = lines.select("log", "seq", "raw", *cols)
    return out.withColumns({"timestamp": event_time(F.col("timestamp")), "pii_entities_found": F.coalesce("pii_entities_found", F.array().cast("array<string>"))})


def events_frame(spark: SparkSession, events: list[dict]) -> DataFrame:
    """In-memory events; there is no chain to check."""
    return spark.createDataFrame([{k: e.get(k) for k in (x.split()[0] for x in AUDIT.split(", "))} for e in events], AUDIT)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path)


def write_lines(df: DataFrame, path: str, column: str = "raw") -> None:
    """Append JSONL lines; the commit protocol stands in for a flush per line."""
    df.select(column).write.mode("append").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def save_report(spark: SparkSession, report: dict, path: str) -> None:
    """The report as one JSON file at a path of any file system that Spark reads."""
    put_text(spark, json.dumps(report, indent=2, default=str), path)


def put_text(spark: SparkSession, text: str, path: str) -> None:
    """Write a small text file through Hadoop's file systems, in place of what was there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def key_from_conf(spark: SparkSession, name: str, least: int = 16, exact: int | None = None) -> bytes:
    """A key from a hex string in the session's configuration; ValueError where it is unset, malformed or of the wrong length."""
    value = spark.conf.get(name, None)
    if not value:
        raise ValueError(f"{name} is not set")
    return load_key(value, least, exact)


def validate_policy(policy: dict) -> list[tuple[str, str]]:
    """(path, message) of everything wrong with a policy, by path; an empty list if it is fine."""
    out: list[tuple[str, str]] = []
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)

    def amount(path: str, v) -> None:
        if not number(v) or v < 0:
            out.append((path, "must be a number of at least 0"))

    def only(path: str, d: dict, names: set[str]) -> None:
        out.extend((f"{path}{k}", "unknown key") for k in d if k not in names)

    if not isinstance(policy, dict):
        return [("", "must be an object")]
    only("", policy, {"max_per_call_usd", "daily_limit_usd", "per_endpoint", "window_seconds", "agent_id", "mpa"})
    for k in ("max_per_call_usd", "daily_limit_usd"):
        if k in policy:
            amount(k, policy[k])
    if "per_endpoint" in policy:
        if isinstance(policy["per_endpoint"], dict):
            for k, v in policy["per_endpoint"].items():
                amount(f"per_endpoint/{k}", v)
        else:
            out.append(("per_endpoint", "must be an object"))
    w = policy.get("window_seconds", 1)
    if not isinstance(w, int) or isinstance(w, bool) or w < 1:
        out.append(("window_seconds", "must be an integer of at least 1"))
    if "agent_id" in policy and not isinstance(policy["agent_id"], str):
        out.append(("agent_id", "must be a string"))
    m = policy.get("mpa")
    if m is not None:
        if not isinstance(m, dict):
            return sorted([*out, ("mpa", "must be an object")])
        only("mpa/", m, {"threshold", "approvers", "min_amount_usd", "timeout_seconds", "dns_rebinding_protection"})
        t = m.get("threshold")
        if not isinstance(t, int) or isinstance(t, bool) or t < 1:
            out.append(("mpa/threshold", "must be an integer of at least 1"))
        a = m.get("approvers")
        if not isinstance(a, list) or not a:
            out.append(("mpa/approvers", "must have an approver"))
        for i, x in enumerate(a if isinstance(a, list) else []):
            p = f"mpa/approvers/{i}"
            if not isinstance(x, dict):
                out.append((p, "must be an object"))
                continue
            only(f"{p}/", x, {"approver_id", "mode", "webhook_url"})
            if not isinstance(x.get("approver_id"), str):
                out.append((f"{p}/approver_id", "is required"))
            if x.get("mode") not in ("webhook", "crypto"):
                out.append((f"{p}/mode", "must be webhook or crypto"))
    return sorted(out)


def load_policy(path: str):
    """A Policy from a .toml or .json file; ValueError lists everything that is wrong. The mpa part is left out."""
    from ..operators.admission import Policy

    raw = tomllib.loads(Path(path).read_text()) if path.endswith(".toml") else json.loads(Path(path).read_text())
    if errors := validate_policy(raw):
        raise ValueError("; ".join(f"{p or '.'}: {m}" for p, m in errors))
    return Policy(**{k: v for k, v in raw.items() if k not in ("mpa", "agent_id")})
