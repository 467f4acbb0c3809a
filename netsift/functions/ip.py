"""IP-address column functions.

Range predicates use one regex per special-range table, derived from the CIDR
tables of Python's standard ``ipaddress`` module (the IANA special
registries, which the reference consults): a handful of codegen'd regex
matches per row, no parsing, no higher-order functions. ``ipv4_to_long`` is
kept for range joins (CIDR matching). IPv6 text is parsed to its 32 hex digits
and tested the same way; IPv4-mapped addresses count as their IPv4 address.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_STRICT = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

# --- fixed values -------------------------------------------------------------
# P5: the detector's private-address pattern (textual, not the IANA table).
PRIVATE_IP_PATTERN = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|127\.)"
# Destination prefixes treated as well-known services.
SAFE_PREFIXES = ["8.8.", "1.1.", "52.", "54.", "13.", "104.", "172.217."]
# Public resolvers shown as "Public DNS" in the graph.
PUBLIC_DNS = ["8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "114.114.114.114"]
# Literal addresses dropped from the graph.
GRAPH_DROP = ["0.0.0.0", "255.255.255.255", "127.0.0.1"]
# ------------------------------------------------------------------------------


def _v4_ranges(nets) -> list[tuple[int, int]]:
    return [(int(n.network_address), int(n.broadcast_address)) for n in nets]


_C4 = ipaddress.IPv4Address._constants
V4_PRIVATE = _v4_ranges(_C4._private_networks)
V4_PRIVATE_EXCEPT = _v4_ranges(getattr(_C4, "_private_networks_exceptions", []))
V4_LOOPBACK = _v4_ranges([_C4._loopback_network])
V4_LINK_LOCAL = _v4_ranges([_C4._linklocal_network])
V4_MULTICAST = _v4_ranges([_C4._multicast_network])
V4_RESERVED = _v4_ranges([_C4._reserved_network])


def _octet_alternation(lo: int, hi: int) -> str:
    return "(" + "|".join(str(v) for v in range(lo, hi + 1)) + ")"


def cidr_regex(net) -> str:
    """A regex matching exactly the dotted-quad addresses of an IPv4 network
    (strict addresses only; combine with IPV4_STRICT)."""
    octets = str(net.network_address).split(".")
    full, rem = divmod(net.prefixlen, 8)
    parts = [octets[i] for i in range(full)]
    if rem:
        base = int(octets[full])
        parts.append(_octet_alternation(base, base + (1 << (8 - rem)) - 1))
    n = len(parts)
    if n == 0:
        return "^"
    body = r"\.".join(parts)
    return "^" + body + (r"\." if n < 4 else "$")


def networks_regex(nets) -> str:
    return "|".join(f"(?:{cidr_regex(n)})" for n in nets) or "(?!)"


# One regex per special-range table: a single codegen'd match per row.
RX_PRIVATE = networks_regex(_C4._private_networks)
RX_PRIVATE_EXCEPT = networks_regex(getattr(_C4, "_private_networks_exceptions", []))
RX_LOOPBACK_OR_LINK_LOCAL = networks_regex([_C4._loopback_network, _C4._linklocal_network])
RX_GRAPH_EXCLUDED = networks_regex([_C4._multicast_network, _C4._linklocal_network, _C4._reserved_network])


_C6 = ipaddress.IPv6Address._constants


def cidr6_regex(net) -> str:
    """A regex on the 32 hex digits of an address: inside the IPv6 network."""
    full, rem = divmod(net.prefixlen, 4)
    digits = f"{int(net.network_address):032x}"
    if not rem:
        return "^" + digits[:full]
    base = int(digits[full], 16)
    return f"^{digits[:full]}[{''.join(f'{v:x}' for v in range(base, base + (1 << (4 - rem))))}]"


def networks6_regex(nets) -> str:
    return "|".join(f"(?:{cidr6_regex(n)})" for n in nets) or "(?!)"


RX6_PRIVATE = networks6_regex(_C6._private_networks)
RX6_PRIVATE_EXCEPT = networks6_regex(getattr(_C6, "_private_networks_exceptions", []))
RX6_LOOPBACK_OR_LINK_LOCAL = networks6_regex([ipaddress.ip_network("::1/128"), _C6._linklocal_network])
RX6_GRAPH_EXCLUDED = networks6_regex([_C6._multicast_network, _C6._linklocal_network, ipaddress.ip_network("::/128"),
                                      *_C6._reserved_networks])
MAPPED = "0" * 20 + "ffff"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ipv4_to_long(c) -> Column:
    """Dotted-quad text → BIGINT, NULL when not a strict IPv4 address."""
    c = _col(c)
    p = F.split(c, r"\.")
    val = (p.getItem(0).cast("bigint") * 16777216 + p.getItem(1).cast("bigint") * 65536
           + p.getItem(2).cast("bigint") * 256 + p.getItem(3).cast("bigint"))
    return F.when(c.rlike(IPV4_STRICT), val)


def in_ranges(v: Column, ranges: list[tuple[int, int]]) -> Column:
    if not ranges:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [v.between(lo, hi) for lo, hi in ranges])


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_GROUPS = "^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"
_DOTTED_TAIL = rf":{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _with_hex_tail(t: Column) -> Column:
    """The address with a dotted IPv4 ending written as two groups."""
    octet = lambda i: F.lpad(F.lower(F.hex(F.regexp_extract(t, _DOTTED_TAIL, i).cast("int"))), 2, "0")
    return F.when(t.rlike(_DOTTED_TAIL), F.concat(F.regexp_replace(t, "[^:]+$", ""), octet(1), octet(2), F.lit(":"), octet(3), octet(4))) \
        .otherwise(t)


def _padded(part: Column) -> Column:
    return F.transform(F.array_remove(F.split(part, ":"), ""), lambda g: F.lpad(g, 4, "0"))


def _joined_halves(halves: Column) -> Column:
    """32 hex digits from (left, right, short); NULL unless the groups make an address."""
    def join(groups: Column) -> Column:
        left, right = groups["left"], groups["right"]
        n = F.size(left) + F.size(right)
        return F.when((halves["short"] & (n <= 7)) | (~halves["short"] & (n == 8)),
                      F.concat(F.array_join(left, ""), F.repeat(F.lit("0000"), 8 - n), F.array_join(right, "")))

    good = halves["left"].rlike(_GROUPS) & halves["right"].rlike(_GROUPS)
    return F.when(good, bound(F.struct(_padded(halves["left"]).alias("left"), _padded(halves["right"]).alias("right")), join))


def ipv6_hex(c) -> Column:
    """IPv6 text → its 32 hex digits; NULL when it isn't an IPv6 address."""
    def halves(t: Column) -> Column:
        at = F.instr(t, "::")
        return F.struct(F.when(at > 0, F.substring_index(t, "::", 1)).otherwise(t).alias("left"),
                        F.when(at > 0, F.substr(t, at + 2)).otherwise(F.lit("")).alias("right"), (at > 0).alias("short"))

    plain = F.regexp_replace(F.lower(_col(c)), "%[^%/]+$", "")
    parsed = bound(plain, lambda p: bound(_with_hex_tail(p), lambda t: bound(halves(t), _joined_halves)))
    return F.when(_col(c).contains(":"), parsed)


def _dotted(six: Column) -> Column:
    """The IPv4 text of an IPv4-mapped address."""
    return F.concat_ws(".", *[F.conv(F.substring(six, 25 + 2 * i, 2), 16, 10) for i in range(4)])


def _by_kind(c: Column, four, six) -> Column:
    """``four(text)`` for an IPv4 or IPv4-mapped address, ``six(hex digits)`` for any other IPv6 one, else NULL."""
    return F.when(c.rlike(IPV4_STRICT), four(c)).when(c.contains(":"), bound(
        ipv6_hex(c), lambda h: F.when(h.startswith(MAPPED), bound(_dotted(h), four)).otherwise(six(h))))


def _private4(t: Column) -> Column:
    return t.rlike(RX_PRIVATE) & ~t.rlike(RX_PRIVATE_EXCEPT)


def _private6(h: Column) -> Column:
    return h.rlike(RX6_PRIVATE) & ~h.rlike(RX6_PRIVATE_EXCEPT)


def is_private_pattern(c) -> Column:
    """P5: textual private-address test; NULL → false; IPv6 is never private."""
    return F.coalesce(_col(c).rlike(PRIVATE_IP_PATTERN), F.lit(False))


def is_external_ip(c) -> Column:
    """Parses as an address and is not private, loopback or link-local.

    Unparsable values (and NULL) are false, i.e. dropped by a filter. IPv4
    ranges are tested with regexes derived from the CIDR tables, so the
    predicate is a few codegen'd regex matches per row.
    """
    return F.coalesce(_by_kind(_col(c), lambda t: ~_private4(t) & ~t.rlike(RX_LOOPBACK_OR_LINK_LOCAL),
                               lambda h: ~_private6(h) & ~h.rlike(RX6_LOOPBACK_OR_LINK_LOCAL)), F.lit(False))


def is_ip_private(c) -> Column:
    """Python ``ip_address(x).is_private`` (NULL when unparsable)."""
    return _by_kind(_col(c), _private4, _private6)


def is_graph_valid_ip(c) -> Column:
    """Endpoint kept in the communication graph."""
    s = F.trim(_col(c))
    # The standard library calls a mapped address reserved by its IPv6 form, so the digits decide here.
    parsed_ok = F.when(s.rlike(IPV4_STRICT), ~s.rlike(RX_GRAPH_EXCLUDED) & (s != "0.0.0.0")) \
        .when(s.contains(":"), bound(ipv6_hex(s), lambda h: ~h.rlike(RX6_GRAPH_EXCLUDED)))
    ok = (s != "") & ~s.isin(*GRAPH_DROP) & ~s.endswith(".255") & parsed_ok
    return F.coalesce(ok, F.lit(False))


def ip_category(c) -> Column:
    """Gateway/Router, Internal Host, Public DNS or External Server."""
    c = _col(c)
    priv = F.coalesce(is_ip_private(c), F.lit(False))
    return (F.when(priv & (c.endswith(".1") | c.endswith(".254")), "Gateway/Router")
            .when(priv, "Internal Host")
            .when(c.isin(*PUBLIC_DNS), "Public DNS")
            .otherwise("External Server"))


def has_safe_prefix(c) -> Column:
    """Destination starts with a well-known service prefix."""
    c = _col(c)
    return F.coalesce(reduce(lambda a, b: a | b, [c.startswith(p) for p in SAFE_PREFIXES]), F.lit(False))


def cidr_bounds(c) -> tuple[Column, Column, Column]:
    """``a.b.c.d/len`` (or a bare address) → (start, end, prefix length) as BIGINT."""
    c = F.trim(F.split(_col(c), ";").getItem(0))
    parts = F.split(c, "/")
    addr = parts.getItem(0)
    plen_txt = F.try_element_at(parts, F.lit(2))
    plen = F.coalesce(F.when(plen_txt.rlike(r"^(3[0-2]|[12]?[0-9])$"), plen_txt.cast("int")), F.lit(32))
    base = ipv4_to_long(addr)
    size = F.pow(F.lit(2.0), 32 - plen).cast("bigint")  # exact below 2^53
    start = base - F.pmod(base, size)
    return start, start + size - 1, plen
