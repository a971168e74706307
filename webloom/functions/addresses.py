"""Refused addresses in every spelling, IPv6 forms that carry an IPv4 address included."""

from __future__ import annotations

import ipaddress
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks by policy. Fixed values.
ALWAYS = ["169.254.0.0/16", "fe80::/10"]
STRICT = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "0.0.0.0/8", "100.64.0.0/10", "::1/128", "::/128", "fc00::/7"]
NAT64, COMPATIBLE = "64:ff9b::/96", "::/96"


def _embedded(address: ipaddress.IPv6Address) -> ipaddress.IPv4Address | None:
    """The IPv4 destination of a mapped, 6to4, NAT64 or compatible address."""
    known = address.ipv4_mapped or address.sixtofour
    if known is None and (address in ipaddress.ip_network(NAT64) or (address in ipaddress.ip_network(COMPATIBLE) and int(address) > 1)):
        known = ipaddress.IPv4Address(int(address) & 0xFFFFFFFF)
    return known


@lru_cache(maxsize=100_000)
def is_refused(host: str | None, strict: bool) -> bool:
    """Whether a host is an address literal in a refused network; names are not."""
    try:
        address = ipaddress.ip_address((host or "").strip("[]"))
    except ValueError:
        return False
    forms = [address]
    if isinstance(address, ipaddress.IPv6Address) and (inner := _embedded(address)) is not None:
        forms.append(inner)
    networks = [ipaddress.ip_network(n) for n in ALWAYS + (STRICT if strict else [])]
    return any(f in n for f in forms for n in networks if f.version == n.version)


def refused(host: Column, strict: Column) -> Column:
    """``is_refused``, Arrow-batched; plain IPv4 needs only the expression in ``functions.urls``."""

    @F.pandas_udf("boolean")
    def check(hosts: pd.Series, policies: pd.Series) -> pd.Series:
        return pd.Series([is_refused(h, bool(s)) for h, s in zip(hosts, policies, strict=True)])

    return check(host, strict)
