"""Volume of payments by chain and project. The facilitator list is small and joined as Spark sees fit by its size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def facilitator_list(facilitators: DataFrame, samples: int = 3) -> DataFrame:
    """Wallets per chain and project, with the smallest addresses; each task keeps only as many as are shown."""
    keys = ("blockchain", "project")
    by = Window.partitionBy(*keys).orderBy("address")
    first = facilitators.withColumn("r", F.row_number().over(by)).where(F.col("r") <= samples).groupBy(*keys).agg(F.array_sort(F.collect_list("address")).alias("sample_addresses"))
    counts = facilitators.groupBy(*keys).agg(F.count("*").alias("wallet_count"))
    same = [counts[k].eqNullSafe(first[k]) for k in keys]
    return counts.join(first, same).select(counts["blockchain"], counts["project"], "wallet_count", "sample_addresses").orderBy(F.desc("wallet_count"), *keys)


def _volume(joined: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    days = F.countDistinct(F.date_trunc("day", "block_time"))
    n = F.count("*")
    out = joined.groupBy(*keys).agg(
        n.alias("tx_count"), F.min("block_time").alias("first_tx"), F.max("block_time").alias("last_tx"), days.alias("active_days"), F.round(n / F.nullif(days, F.lit(0)), 1).alias("avg_tx_per_day")
    )
    out = out.orderBy(F.desc("tx_count"), *keys)
    return out.limit(limit) if limit else out


def _recent(tx: DataFrame, since: str) -> DataFrame:
    return tx.where(F.col("success") & (F.col("block_time") >= F.lit(since).cast("timestamp_ntz")))


def by_chain_and_project(facilitators: DataFrame, tx: DataFrame, since: str, limit: int = 100) -> DataFrame:
    t = _recent(tx, since)
    joined = t.join(facilitators, (t["from"] == facilitators["address"]) & (t["blockchain"] == facilitators["blockchain"])).select(facilitators["blockchain"], "project", "block_time")
    return _volume(joined, "blockchain", "project", limit=limit)


def single_chain(facilitators: DataFrame, tx: DataFrame, chain: str, since: str) -> DataFrame:
    f, t = facilitators.where(F.col("blockchain") == chain), _recent(tx, since).where(F.col("blockchain") == chain)
    return _volume(t.join(f, t["from"] == f["address"]).select("project", "block_time"), "project")


def other_chains(facilitators: DataFrame, tx: DataFrame, known: tuple[str, ...], since: str) -> DataFrame:
    f, t = facilitators.where(~F.col("blockchain").isin(*known)), _recent(tx, since)
    joined = t.join(f, (t["from"] == f["address"]) & (t["blockchain"] == f["blockchain"])).select(f["blockchain"], "project", "block_time")
    return _volume(joined, "blockchain", "project").drop("first_tx")


def chain_totals(facilitators: DataFrame, tx: DataFrame, chain: str, since: str) -> DataFrame:
    f, t = facilitators.where(F.col("blockchain") == chain), _recent(tx, since).where(F.col("blockchain") == chain)
    return t.join(f, t["from"] == f["address"], "left_semi").agg(F.count("*").alias("tx_count"), F.min("block_time").alias("first_tx"), F.max("block_time").alias("last_tx"))


def resolve_unknowns(facilitators: DataFrame, addresses: tuple[str, ...]) -> DataFrame:
    return facilitators.where(F.lower(F.col("address").cast("string")).isin(*[a.lower() for a in addresses])).select(F.col("address").cast("string").alias("address"), "project", "blockchain").orderBy("address")
