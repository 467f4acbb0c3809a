"""Flow queries: P1 filter semantics, summaries and profiles (A1-A8), top flows."""

import pytest
from conftest import flows_df

from netsift.operators import flows as fl


def _df(spark):
    return flows_df(spark, [
        dict(src_ip="10.0.0.1", dst_ip="8.8.8.8", dst_port=53, protocol=17, application_name="DNS",
             bidirectional_bytes=100, bidirectional_packets=2, bidirectional_first_seen_ms=1000,
             bidirectional_last_seen_ms=1500),
        dict(src_ip="10.0.0.2", dst_ip="8.8.8.8", dst_port=53, protocol=17, application_name="DNS",
             bidirectional_bytes=300, bidirectional_packets=4, bidirectional_first_seen_ms=900,
             bidirectional_last_seen_ms=1200),
        dict(src_ip="10.0.0.1", dst_ip="1.2.3.4", dst_port=443, protocol=6, application_name="TLS",
             bidirectional_bytes=2_000_000, bidirectional_packets=900, bidirectional_first_seen_ms=2000,
             bidirectional_last_seen_ms=9000),
        dict(src_ip=None, dst_ip="1.2.3.4", dst_port=0, protocol=1, application_name=None,
             bidirectional_bytes=300, bidirectional_packets=4),
    ])


def test_filter_flows_and_conditions(spark):
    df = _df(spark)
    assert fl.filter_flows(df).count() == 4
    assert fl.filter_flows(df, dst_port=0).count() == 1          # port 0 is a real filter, not ignored
    assert fl.filter_flows(df, protocol="DNS", min_bytes=200).count() == 1
    assert fl.filter_flows(df, min_bytes=0, min_packets=0).count() == 4
    assert fl.filter_flows(df, src_ip="10.0.0.1", dst_ip="1.2.3.4", min_packets=900).count() == 1


def test_summary_and_distribution(spark):
    df = _df(spark)
    r = fl.traffic_summary(df).collect()[0]
    assert (r.total_flows, r.total_packets, r.total_bytes) == (4, 910, 2_000_700)
    assert (r.unique_src_ips, r.unique_dst_ips, r.unique_protocols) == (2, 2, 3)
    assert (r.start_ms, r.end_ms, r.duration_ms) == (900, 9000, 8100)
    e = fl.traffic_summary(df.limit(0)).collect()[0]
    assert (e.total_flows, e.total_packets, e.total_bytes) == (0, 0, 0)
    assert [(x.application_name, x.flow_count) for x in fl.protocol_distribution(df).collect()] == [
        ("DNS", 2), ("TLS", 1)]
    approx = fl.traffic_summary(df, exact=False).collect()[0]
    assert approx.unique_src_ips == 2


def test_top_talkers_ties_and_nulls(spark):
    df = _df(spark)
    top = [(x.src_ip, x.total_bytes, x.rank) for x in fl.top_talkers(df).collect()]
    assert top == [("10.0.0.1", 2_000_100, 1), ("10.0.0.2", 300, 2)]
    dst = [(x.dst_ip, x.rank) for x in fl.top_destinations(df, k=1).collect()]
    assert dst == [("1.2.3.4", 1)]


def test_profiles(spark):
    df = _df(spark)
    p = fl.port_profile(df, 53)
    s = p["summary"].collect()[0]
    assert (s.total_flows, s.unique_sources, s.unique_destinations, s.total_bytes) == (2, 2, 1, 400)
    assert [x.src_ip for x in p["top_sources"].collect()] == ["10.0.0.2", "10.0.0.1"]
    assert fl.port_profile(df, 8080)["summary"].count() == 0
    with pytest.raises(ValueError):
        fl.port_profile(df, 70000)
    ip = fl.ip_profile(df, "8.8.8.8")
    roles = {x.role: (x.flow_count, x.total_bytes) for x in ip["summary"].collect()}
    assert roles == {"as_source": (0, 0), "as_destination": (2, 400)}
    assert [(x.role, x.peer_ip, x.rank) for x in ip["top_peers"].orderBy("rank").collect()] == [
        ("as_destination", "10.0.0.2", 1), ("as_destination", "10.0.0.1", 2)]
    with pytest.raises(ValueError):
        fl.ip_profile(df, "999.1.1.1")
    app = fl.app_profile(df, "TLS")
    assert app["summary"].collect()[0].total_bytes == 2_000_000
    big = fl.large_flows(df)
    assert big["summary"].collect()[0].flow_count == 1
    assert big["top_flows"].collect()[0].dst_port == 443


def test_top_flows_fallback_and_explore(spark):
    df = _df(spark)
    assert fl.top_flows(df, n=1).collect()[0].bidirectional_packets == 900    # no score column → packets
    scored = df.withColumn("anomaly_score", df.bidirectional_bytes * -1.0)
    assert fl.top_flows(scored, n=1).collect()[0].bidirectional_bytes == 100
    ex = fl.explore(df, n=5, protocol="DNS")
    assert [x.bidirectional_bytes for x in ex.collect()] == [300, 100]
