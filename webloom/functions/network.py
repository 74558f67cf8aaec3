"""Hosts that expressions cannot parse: IPv6 literals and international names, by Arrow UDFs."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from . import urls


def _inner(host: str | None) -> bool | None:
    if host is None:
        return None
    try:
        ip = ipaddress.IPv6Address(host.strip("[]").split("%")[0])
    except ValueError:
        return None  # no address at all
    mapped = ip.ipv4_mapped
    return not (mapped or ip).is_global or (mapped or ip).is_multicast


@F.pandas_udf(BooleanType())
def _inner_ipv6(host: pd.Series) -> pd.Series:
    return host.map(_inner).astype(object)


def blocked_host(host: Column) -> Column:
    """True for IPv4 and IPv6 literals of networks that are never fetched; names are not resolved."""
    six = host.contains(":")
    return F.coalesce(F.when(six, _inner_ipv6(F.when(six, host))).otherwise(urls.blocked_ip(host)), F.lit(False))


def is_public_url(url: Column) -> Column:
    """http or https to a host that is no local name and no address of an inner network; a name needs a dot."""
    host = F.regexp_extract(F.lower(urls.part(url, 2)), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::[0-9]*)?$", 1)
    host = F.regexp_replace(host, r"\.$", "")
    local = (host == "localhost") | host.endswith(".localhost") | host.endswith(".local")
    six = host.startswith("[")
    outer = F.when(six, ~_inner_ipv6(F.when(six, host))).otherwise(host.contains(".") & ~urls.blocked_ip(host))
    return F.coalesce(F.lower(urls.part(url, 1)).isin("http", "https") & (host != "") & ~local & outer, F.lit(False))


def _ascii(name: str | None) -> str | None:
    try:
        return None if name is None else name.encode("idna").decode("ascii")
    except UnicodeError:
        return None


@F.pandas_udf(StringType())
def _idna(name: pd.Series) -> pd.Series:
    return name.map(_ascii).astype(object)


def domain_key(domain: Column) -> Column:
    """Lower-case ASCII name that is safe as a key, international labels encoded; null if it cannot be one."""
    name = F.regexp_replace(F.lower(F.trim(domain)), r"^\.+|\.+$", "")
    foreign = name.rlike(r"[^\x00-\x7F]")
    key = F.when(foreign, _idna(F.when(foreign, name))).when(name.rlike(r"^[^.]{1,63}(\.[^.]{1,63})*$"), name)
    return F.when(key.rlike(r"^[a-z0-9_.-]+$") & ~key.contains(".."), key)


def account_key(account: Column) -> Column:
    """`default` for none, else a safe lower-case key; null if it cannot be one."""
    key = F.lower(F.trim(F.coalesce(account, F.lit(""))))
    return F.when(key.isin("", "default"), "default").when(key.rlike(r"^[a-z0-9_.-]+$") & ~key.contains("..") & (key != "."), key)
