"""HMAC-SHA256 and what is built on it, as native expressions. Keys are literals in the plan: guard explain output."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Lower-case hex HMAC of a string (as UTF-8) or binary column."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    inner = F.sha2(F.concat(pad(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


_HEX = "0123456789abcdef"


def _flipped(key_hex: Column, by: int) -> Column:
    """64 bytes in hex with each byte xor `by`: a digit-wise translation, as `by` flips each hex digit on its own."""
    flip = lambda n: "".join(_HEX[i ^ n] for i in range(16))
    high, low = by >> 4, by & 15
    if high == low:
        return F.translate(key_hex, _HEX, flip(high))
    digits = F.transform(F.split(key_hex, ""), lambda c, i: F.when(i % 2 == 0, F.translate(c, _HEX, flip(high))).otherwise(F.translate(c, _HEX, flip(low))))
    return F.array_join(digits, "")


def hmac_pads(key: Column) -> tuple[Column, Column]:
    """(inner, outer) padded keys of a binary key of any length: made once per key, then joined to messages."""
    short = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    full = F.rpad(F.lower(F.hex(short)), 128, "0")
    return F.unhex(_flipped(full, 0x36)), F.unhex(_flipped(full, 0x5C))


def hmac_padded(message: Column, inner: Column, outer: Column) -> Column:
    """Lower-case hex HMAC-SHA256 under a key given as its two pads."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def fingerprint(url: Column, pay_to: Column, amount: Column, currency: Column, deadline: Column, key: bytes) -> Column:
    """HMAC over the fields joined by '|'; amount is the string as given."""
    return hmac_sha256(F.concat_ws("|", url, pay_to, amount, currency, deadline.cast("string")), key)


def _ascii_json(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")))


def canonical_approval(resource_url: Column, amount_usd: Column, network: Column, agent_id: Column, ascii_only: bool = True) -> Column:
    """Compact JSON with sorted keys that approvers sign; the amount has six decimals.

    Characters outside ASCII are escaped if ascii_only, by an Arrow UDF, as Spark's to_json leaves them as they are.
    """
    out = F.to_json(F.struct(agent_id.alias("agent_id"), F.format_string("%.6f", amount_usd).alias("amount_usd"), network.alias("network"), resource_url.alias("resource_url")), {"ignoreNullFields": "false"})
    return F.pandas_udf(_ascii_json, "string")(out) if ascii_only else out


def webhook_signature(body: Column, key: bytes) -> Column:
    """The header that lets a webhook check the body it gets, and the engine the answer: the HMAC of the body's bytes in hex."""
    return hmac_sha256(body, key)


def short_id(fingerprint: Column) -> Column:
    """The first 16 characters of a fingerprint, as logs and messages show it."""
    return F.substring(fingerprint, 1, 16)


def load_key(value: str, least: int = 16, exact: int | None = None) -> bytes:
    """A key from hex; raises ValueError where it is malformed, too short or not of the exact length."""
    key = bytes.fromhex(value)
    if len(key) < least or exact is not None and len(key) != exact:
        raise ValueError("the key has the wrong length")
    return key
