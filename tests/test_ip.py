"""Address predicates (P6, P7, P8) against the standard library, with IPv6 boundaries."""

import ipaddress
import random

from netsift.functions import ip as ipf

EDGES = ["2001::1", "2001:0db8::1", "2001:db8::", "2001:db9::", "fd:1::2", "fd00::1", "fdff::1", "fe00::1", "fe80::1", "febf::1", "fec0::1",
         "1:2", ":::::", "::", "::1", "::2", "4000::1", "3fff:ffff::1", "3fff::1", "64:ff9b::1", "64:ff9b:1::1", "2606:4700::1111",
         "ff02::1", "100::1", "100:0:0:1::1", "2002::1", "2001:1::1", "2001:1::2", "2001:1::3", "2001:3::1", "2001:4:112::1",
         "2001:20::1", "2001:2f::1", "2001:30::1", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::ffff:0808:0808", "::ffff:256.1.1.1",
         "::ffff:224.0.0.1", "64:ff9b::8.8.8.8", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "12345::1", "g::1",
         "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "fe80::1%eth0", "2A00:1450::200E", "1.2.3.4::", "8.8.8.8", "10.0.0.1",
         "192.0.0.9", "240.0.0.1", "169.254.1.1", "127.0.0.2", "01.2.3.4", "1.2.3", "x", "", None, ":", "::1.2.3.4", "1::1.2.3"]


def parsed(t):
    try:
        return ipaddress.ip_address(t)
    except ValueError:
        return None


def sample():
    rng = random.Random(7)
    out = list(EDGES)
    for _ in range(400):
        a = ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 0, 16, 64, 96]) | rng.choice([0, 0x2001 << 112, 0xFE80 << 112, 0xFD << 120]))
        out += [str(a), a.exploded.upper()]
    return out


def test_predicates_equal_the_standard_library(spark):
    rows = sample()
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = df.select("t", ipf.is_external_ip("t").alias("e"), ipf.is_graph_valid_ip("t").alias("g"), ipf.is_ip_private("t").alias("p")).collect()
    for r in got:
        a = parsed(r.t) if r.t is not None else None
        assert r.p == (a.is_private if a else None), r
        assert r.e == bool(a and not (a.is_private or a.is_loopback or a.is_link_local)), r
        kept = bool(a and not (a.is_multicast or a.is_link_local or a.is_unspecified or a.is_reserved))
        assert r.g == (kept and r.t not in ipf.GRAPH_DROP and not r.t.endswith(".255")), r
