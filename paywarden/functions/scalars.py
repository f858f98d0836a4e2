"""Small scalar functions: amounts, messages, retry times, templates, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: currencies pegged to the dollar
PEGGED = ("USDC", "USDT", "DAI", "USDCE", "USDBC")
NUMBER = r"^\s*[+-]?(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?\s*$"


def parse_amount(amount: Column) -> Column:
    """A finite double from a decimal string (underscores between digits allowed), else null."""
    value = F.when(amount.rlike(NUMBER), F.regexp_replace(F.trim(amount), "_", "")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def amount_error(amount: Column, currency: Column) -> Column:
    """not_a_number, negative or unsupported_currency; null where the amount is good."""
    value = parse_amount(amount)
    return (
        F.when(value.isNull(), F.lit("not_a_number")).when(value < 0, F.lit("negative"))
        .when(~F.coalesce(F.upper(currency).isin(*PEGGED), F.lit(False)), F.lit("unsupported_currency"))
    )


def amount_usd(amount: Column, currency: Column) -> Column:
    return F.when(amount_error(amount, currency).isNull(), parse_amount(amount))


def safe_message(message: Column, most: int = 80) -> Column:
    return F.when(F.length(message) > most, F.concat(F.substring(message, 1, most), F.lit("...[truncated]"))).otherwise(message)


def retry_after(value: Column) -> Column:
    """Seconds, at least 0; null where the header is no whole number."""
    n = F.trim(value).try_cast("int")
    return F.when(n.isNotNull(), F.greatest(F.lit(0), n))


def inject(template: Column, text: Column, slot: str = "{SLOT}") -> Column:
    """(text with the first slot filled, start, end); start is -1 where there is no slot."""
    at = F.instr(template, slot)
    full = F.when(at > 0, F.concat(F.substring(template, F.lit(1), at - 1), text, F.substring(template, at + len(slot), F.length(template)))).otherwise(template)
    return F.struct(full.alias("text"), (at - 1).alias("start"), F.when(at > 0, at - 1 + F.length(text)).otherwise(F.lit(-1)).alias("end"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (a_end > b_start)


def repeated(found: Column) -> Column:
    """An array of (entity_type, field, count) spelled out, one element per count."""
    return F.flatten(F.transform(found, lambda e: F.array_repeat(F.struct(e["entity_type"].alias("entity_type"), e["field"].alias("field")), e["count"])))


def round_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def event_time(value: Column) -> Column:
    """ISO-8601 as UTC unless it says otherwise; now where it can't be read."""
    return F.coalesce(F.try_to_timestamp(value), F.current_timestamp())
