"""Hot keys: one source / domain / 5-tuple holding a third or more of the rows.

Results must stay exact; the operators use partial aggregation, salted top-k
and bucketed windows so the hot key is split across tasks.
"""

import random

from conftest import flows_df
from pyspark.sql import functions as F

from netsift.operators import detectors as det
from netsift.operators import flows as fl
from netsift.operators import metering as mt
from netsift.schema import PACKET_SCHEMA


def _skewed(spark, n=3000):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append(dict(src_ip="10.9.9.9" if hot else f"10.0.{i % 7}.{i % 200}",
                         dst_ip="192.168.0.1" if hot else f"45.1.{i % 5}.{i % 9}",
                         dst_port=1000 + (i % 400) if hot else rnd.choice([80, 443]),
                         application_name="DNS", requested_server_name="hot.example.com" if hot else f"n{i % 50}.x.org",
                         bidirectional_packets=1, bidirectional_bytes=rnd.randint(1, 1000)))
    return rows, flows_df(spark, rows)


def test_hot_source_and_domain(spark):
    rows, df = _skewed(spark)
    scan = det.port_scan(df).collect()
    assert [(r.src_ip, r.ports, r.targets, r.packets) for r in scan] == [("10.9.9.9", 400, 1, 1000)]
    names = spark.createDataFrame([("hot.example.com",)], "domain string")
    st = det.domain_query_stats(det.dns_flows(df), names).collect()[0]
    assert st.query_count == 1000 and st.source_ips == "10.9.9.9"
    ps = {r.src_ip: r for r in det.plugin_port_scan(df, threshold=50).collect()}
    assert ps["10.9.9.9"].port_count == 400
    assert ps["10.9.9.9"].sample_ports == ",".join(str(p) for p in range(1000, 1020))
    top = fl.top_talkers(df, k=3).collect()
    exp = {}
    for r in rows:
        exp[r["src_ip"]] = exp.get(r["src_ip"], 0) + r["bidirectional_bytes"]
    best = sorted(exp.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
    assert [(r.src_ip, r.total_bytes) for r in top] == best


def test_hot_five_tuple_metering_is_bucket_independent(spark):
    rnd = random.Random(9)
    t, data = 0, []
    for i in range(1500):                       # one long connection with half of all packets
        t += rnd.choice([10, 20, 5000])
        data.append((i, "10.0.0.1", "8.8.8.8", 5000, 53, 17, t, 100))
    for i in range(1500, 3000):
        data.append((i, f"10.0.1.{i % 50}", "8.8.4.4", 6000 + i % 50, 53, 17, rnd.randint(0, t), 60))
    pk = spark.createDataFrame(data, PACKET_SCHEMA)
    cols = ["src_ip", "src_port", "bidirectional_first_seen_ms", "bidirectional_packets", "bidirectional_bytes"]
    ref = sorted(tuple(r) for r in mt.meter(pk, 3000, 60000, bucket_ms=10**12).select(*cols).collect())
    for b in (1000, 7000, 60000):
        got = sorted(tuple(r) for r in mt.meter(pk, 3000, 60000, bucket_ms=b).select(*cols).collect())
        assert got == ref, b
    assert sum(r[3] for r in ref) == 3000
