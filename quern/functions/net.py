"""Addresses: which are public, and what may be fetched."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# IPv4 ranges that are not public, as network/prefix.
CLOSED_V4 = """
0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24
192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4
"""
_CLOSED = [ipaddress.ip_network(x) for x in CLOSED_V4.split()]


def ipv4_number(s: Column) -> Column:
    """The address as a number, null if it is none."""
    parts = F.split(s, r"\.")
    n = [F.element_at(parts, i).try_cast("long") for i in range(1, 5)]
    ok = s.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (n[0] < 256) & (n[1] < 256) & (n[2] < 256) & (n[3] < 256)
    return F.when(ok, ((n[0] * 256 + n[1]) * 256 + n[2]) * 256 + n[3])


def ipv4_is_public(number: Column) -> Column:
    out = number.isNotNull()
    for net in _CLOSED:
        out = out & ~number.between(int(net.network_address), int(net.broadcast_address))
    return out


def is_public(address: str) -> bool:
    """Whether an IPv4 or IPv6 address belongs to the public network."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    if ip.is_loopback or ip.is_private or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified:
        return False
    return ip.version == 6 or not any(ip in net for net in _CLOSED)


def may_fetch(url: str) -> bool:
    """http or https with a host, and no closed address written as the host. Names are not resolved."""
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host:
        return False
    try:
        ipaddress.ip_address(host)
    except ValueError:
        return host != "localhost" and not host.endswith(".localhost")
    return is_public(host)


def url_host(s: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(s, r"https?://([^/\s\"'<>?#)\]]+)", 1), F.lit("")))


def client_ip(remote: str, forwarded: str | None, trusted: bool) -> str:
    """The right-most forwarded address if the proxy is trusted, else the peer's."""
    if trusted and forwarded:
        last = forwarded.split(",")[-1].strip()
        if last:
            return last
    return remote.rsplit(":", 1)[0].strip("[]") if remote.count(":") == 1 or remote.startswith("[") else remote
