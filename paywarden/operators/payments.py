"""Payment headers: JSON to payment columns, with errors as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFER = "scheme string, network string, maxAmountRequired string, resource string, description string, reason string, payTo string, requiredDeadlineSeconds int, currency string, extra string"
REQUIRED = ("resource", "payTo", "maxAmountRequired", "network")


def parse_header(header: Column) -> Column:
    """A struct of payment fields and header_error (invalid_json, no_offers, no_exact_scheme, missing_<field>, or null).

    The first offer with scheme `exact` counts. Defaults: currency USDC, deadline 300 s, empty texts, extra {}.
    """
    valid = F.is_valid_variant(F.try_parse_json(header)) if hasattr(F, "is_valid_variant") else F.try_parse_json(header).isNotNull()
    offers = F.from_json(header, f"accepts array<struct<{', '.join(x.replace(' ', ':', 1) for x in OFFER.split(', '))}>>")["accepts"]
    offer = F.get(F.filter(offers, lambda o: o["scheme"] == "exact"), 0)
    error = F.when(header.isNull() | ~F.coalesce(valid, F.lit(False)), F.lit("invalid_json"))
    error = error.when(offers.isNull() | (F.size(offers) == 0), F.lit("no_offers")).when(offer.isNull(), F.lit("no_exact_scheme"))
    for f in REQUIRED:
        error = error.when(offer[f].isNull() | (offer[f] == ""), F.lit(f"missing_{f}"))
    text = lambda f, d: F.coalesce(offer[f], F.lit(d))
    return F.struct(
        offer["resource"].alias("resource_url"), offer["payTo"].alias("pay_to"), offer["maxAmountRequired"].alias("amount"), text("currency", "USDC").alias("currency"), offer["network"].alias("network"),
        F.coalesce(offer["requiredDeadlineSeconds"], F.lit(300)).alias("deadline_seconds"), text("description", "").alias("description"), text("reason", "").alias("reason"), text("extra", "{}").alias("extra"), error.alias("header_error"),
    )


def payment_requests(responses: DataFrame) -> DataFrame:
    """Rows that ask for a payment: status 402 with a header; others pass the engine by."""
    return responses.where((F.col("http_status") == 402) & F.col("x_payment").isNotNull() & (F.col("x_payment") != ""))
