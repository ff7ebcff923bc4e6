"""Checks that need 128-bit numbers or SHA-3: Arrow-batched helpers over the standard library."""

from __future__ import annotations

import base64
import hashlib
import ipaddress

import pandas as pd
from pyspark.sql import functions as F

from .policy import DENIED_IPV4

# IPv6 networks within 2000::/3 that aren't public.
DENIED_IPV6 = "2001::/23 2001:db8::/32 2002::/16 3ffe::/16 3fff::/20".split()


@F.pandas_udf("boolean")
def is_public_ipv6(address: pd.Series) -> pd.Series:
    """Null where it isn't an address; mapped and compatible IPv4 addresses are judged as such, by the same networks as all IPv4 addresses."""
    denied = [ipaddress.ip_network(n) for n in DENIED_IPV6]
    denied_old = [ipaddress.ip_network(n) for n in DENIED_IPV4]
    unicast = ipaddress.ip_network("2000::/3")

    def judge(text):
        try:
            a = ipaddress.IPv6Address(text)
        except (ValueError, TypeError):
            return None
        if int(a) >> 32 in (0, 0xFFFF):
            old = ipaddress.IPv4Address(int(a) & 0xFFFFFFFF)
            return not any(old in n for n in denied_old)
        return a in unicast and not any(a in n for n in denied)

    return address.map(judge)


@F.pandas_udf("boolean")
def is_onion_v3(host: pd.Series) -> pd.Series:
    """56 base-32 characters before ``.onion``, of version 3 and with the right checksum."""

    def judge(text):
        name, _, rest = (text or "").rpartition(".onion")
        if rest or len(name) != 56:
            return False
        try:
            raw = base64.b32decode(name.upper())
        except ValueError:
            return False
        key, check, version = raw[:32], raw[32:34], raw[34:]
        return version == b"\x03" and hashlib.sha3_256(b".onion checksum" + key + version).digest()[:2] == check

    return host.map(judge)
