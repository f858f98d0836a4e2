"""The engine's relations as views of star-schema tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = {"click": "PAYMENT_ALLOWED", "purchase": "PII_REDACTED", "error": "PAYMENT_ERROR", "signup": "POLICY_BLOCKED", "view": "REPLAY_BLOCKED"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facilitators(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("address"), F.col("c_mktsegment").alias("project"), F.col("n_name").alias("blockchain"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.select(F.col("o_custkey").alias("from"), F.col("n_name").alias("blockchain"), F.col("o_orderdate").alias("block_time"), (F.col("o_orderstatus") != "P").alias("success"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    url = F.concat(F.lit("https://"), "event_type", F.lit(".example.com/"), F.col("user_id").cast("string"))
    return e.select(
        F.col("event_id").alias("payment_id"), F.col("user_id").alias("agent_id"), F.col("event_id").alias("seq"), "ts", url.alias("resource_url"), F.concat(F.lit("0x"), (F.col("user_id") % 7).cast("string")).alias("pay_to"),
        F.col("value").cast("string").alias("amount"), F.col("value").alias("amount_usd"), F.lit("USDC").alias("currency"), F.lit("base").alias("network"), F.lit(300).alias("deadline_seconds"), F.col("props").alias("extra"), "event_type",
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])[F.col("event_type")]
    found = F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 2 == 0, F.array(F.lit("EMAIL_ADDRESS"), F.lit("US_SSN"))).otherwise(F.array(F.lit("EMAIL_ADDRESS")))).otherwise(F.array().cast("array<string>"))
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").alias("timestamp"), kind.alias("event_type"), F.col("value").alias("amount_usd"), F.col("user_id").cast("string").alias("agent_id"),
        F.when(F.col("event_type").isin("signup", "view", "error"), "blocked").otherwise("allowed").alias("outcome"), found.alias("pii_entities_found"),
    )
