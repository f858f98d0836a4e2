"""Origins, endpoint prefixes and address checks."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: networks that a webhook must not point at
BLOCKED = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "0.0.0.0/8", "::1/128", "fc00::/7", "fe80::/10", "::/128")
_V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"


def base(url: Column) -> Column:
    """scheme://authority as written."""
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)", 1), F.lit("://"), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)", 2))


def origin(url: Column) -> Column:
    """Lower-case scheme://host[:port] without a default port; null where the url has no authority."""
    b = F.regexp_replace(F.lower(base(url)), r"://[^/@]*@", "://")
    b = F.regexp_replace(F.regexp_replace(b, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]"), b)


def ipv4_number(ip: Column) -> Column:
    o = F.transform(F.split(ip, r"\."), lambda x: x.cast("long"))
    return F.when(ip.rlike(_V4), ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3])


def ipv4_blocked(ip: Column) -> Column:
    """Whether an IPv4 address lies in a blocked network; null if it is none."""
    n, out = ipv4_number(ip), F.lit(False)
    for net in map(ipaddress.ip_network, BLOCKED):
        if net.version == 4:
            out = out | n.between(int(net.network_address), int(net.broadcast_address))
    return F.when(n.isNotNull(), out)


def _any_blocked(s: pd.Series) -> pd.Series:
    nets = [ipaddress.ip_network(n) for n in BLOCKED]

    def one(x: str | None) -> bool | None:
        try:
            ip = ipaddress.ip_address(x)
        except ValueError:
            return None
        return any(ip.version == n.version and ip in n for n in nets)

    return s.map(one)


def ip_blocked(ip: Column) -> Column:
    """As ipv4_blocked, with IPv6 through an Arrow UDF."""
    return F.when(ip.contains(":"), F.pandas_udf(_any_blocked, "boolean")(ip)).otherwise(ipv4_blocked(ip))


def host(url: Column) -> Column:
    """The host of a url without user, port and brackets; empty where there is none."""
    authority = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), r"^[^@]*@", "")
    six = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    return F.when(six != "", six).otherwise(F.regexp_replace(authority, r":[0-9]*$", ""))


def webhook_error(url: Column) -> Column:
    """Why a webhook url is refused, or null: empty, not_https, no_host, blocked_address (literal IPv4 or IPv6)."""
    return (
        F.when(url.isNull() | (url == ""), F.lit("empty")).when(~F.lower(url).startswith("https://"), F.lit("not_https"))
        .when(host(url) == "", F.lit("no_host")).when(F.coalesce(ip_blocked(host(url)), F.lit(False)), F.lit("blocked_address"))
    )


def longest_prefix(url: Column, prefixes: list[str]) -> Column:
    """The longest of some configured prefixes that the url (or its scheme://authority) starts with, else null."""
    out = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        out = F.when(url.startswith(p) | base(url).startswith(p), F.lit(p)).otherwise(out)
    return out
