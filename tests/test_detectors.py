"""Boundary rows for every rule detector (FIXTURES.md part A, boundary list)."""

from conftest import flows_df

from netsift.operators import detectors as det


def test_dns_tunnel_boundary(spark):
    rows = [dict(application_name="DNS", dst_ip="1.1.1.1", bidirectional_packets=20),
            dict(application_name="DNS", dst_ip="2.2.2.2", bidirectional_packets=21),
            dict(application_name="DNS", dst_ip="3.3.3.3", bidirectional_packets=10),
            dict(application_name="DNS", dst_ip="3.3.3.3", bidirectional_packets=11),
            dict(application_name="TLS", dst_ip="4.4.4.4", bidirectional_packets=99),
            dict(application_name="DNS", dst_ip=None, bidirectional_packets=99)]
    got = {r.dst_ip: r.packet_count for r in det.dns_tunnel(flows_df(spark, rows)).collect()}
    assert got == {"2.2.2.2": 21, "3.3.3.3": 21}


def test_dga_label_length_and_case(spark):
    rows = [dict(application_name="DNS", requested_server_name="abcdefghij.com"),      # 10 chars
            dict(application_name="DNS", requested_server_name="abcdefghijk.com"),     # 11 chars, entropy 3.46
            dict(application_name="DNS", requested_server_name="a1b2c3d4e5f6g7.com"),  # 14 distinct -> 3.81
            dict(application_name="DNS", requested_server_name="A1B2C3D4E5F6G7.NET"),  # raw case kept
            dict(application_name="DNS", requested_server_name="single")]
    got = {r.domain: r.entropy for r in det.dga_domains(flows_df(spark, rows)).collect()}
    assert set(got) == {"a1b2c3d4e5f6g7.com", "A1B2C3D4E5F6G7.NET"}
    assert abs(got["a1b2c3d4e5f6g7.com"] - 3.8073549220576046) < 1e-12


def test_http_exfiltration_ratio_and_floor(spark):
    rows = [dict(application_name="HTTP", src2dst_bytes=100_000, dst2src_bytes=1_000_000),   # not > 10x
            dict(application_name="TLS", src2dst_bytes=100_000, dst2src_bytes=1_000_001),    # > 10x and > 1e6
            dict(application_name="HTTPS", src2dst_bytes=10, dst2src_bytes=1_000_000),       # not > 1e6
            dict(application_name="DNS", src2dst_bytes=10, dst2src_bytes=9_000_000),         # not HTTP
            dict(application_name="HTTP", src2dst_bytes=0, dst2src_bytes=9_000_000)]         # s2d = 0
    got = det.http_exfiltration(flows_df(spark, rows)).collect()
    assert len(got) == 1 and got[0].dst2src_bytes == 1_000_001


def test_uncommon_port_counts(spark):
    rows = [dict(dst_port=7777)] * 10 + [dict(dst_port=8888)] * 11 + [dict(dst_port=443)] * 50 + [dict(dst_port=None)] * 20
    got = {r.port: r["count"] for r in det.uncommon_ports(flows_df(spark, rows)).collect()}
    assert got == {8888: 11}


def test_user_agent_hits(spark):
    rows = [dict(user_agent="python-requests/2.28"), dict(user_agent="Mozilla/5.0"),
            dict(user_agent="CURL/8 Java/17"), dict(user_agent=None)]
    got = {r.user_agent: r.hits for r in det.suspicious_user_agents(flows_df(spark, rows)).collect()}
    assert got == {"python-requests/2.28": "python-requests", "CURL/8 Java/17": "curl,java/"}


def test_icmp_and_dns_exfil_thresholds(spark):
    rows = [dict(protocol=1, bidirectional_bytes=1000), dict(protocol=1, bidirectional_bytes=1001),
            dict(application_name="DNS", bidirectional_bytes=500), dict(application_name="DNS", bidirectional_bytes=501)]
    df = flows_df(spark, rows)
    assert [r.bytes for r in det.icmp_tunnel(df).collect()] == [1001]
    assert [r.bytes for r in det.dns_exfiltration(df).collect()] == [501]


def test_unknown_tls_confidence_and_count(spark):
    rows = ([dict(application_name="TLS", dst_ip="a", application_confidence=49)] * 4
            + [dict(application_name="TLS", dst_ip="b", application_confidence=49)] * 5
            + [dict(application_name="TLS", dst_ip="c", application_confidence=50)] * 9
            + [dict(application_name="TLS", dst_ip="d", application_confidence=None)] * 9)
    df = flows_df(spark, rows)
    assert {r.dst_ip: r.flows for r in det.unknown_tls(df).collect()} == {"b": 5}
    # a source without the confidence column counts every TLS flow
    assert {r.dst_ip for r in det.unknown_tls(df, require_confidence=False).collect()} == {"b", "c", "d"}


def test_one_way_and_large_transfer(spark):
    rows = [dict(src2dst_bytes=10_000_000, dst2src_bytes=1_000_000, bidirectional_bytes=10_485_760),
            dict(src2dst_bytes=10_000_001, dst2src_bytes=1_000_000, bidirectional_bytes=10_485_761),
            dict(src2dst_bytes=1_000_000, dst2src_bytes=0, bidirectional_bytes=0)]
    df = flows_df(spark, rows)
    assert [r.bytes for r in det.one_way_transfer(df).collect()] == [10_000_001]
    assert [r.bytes for r in det.large_transfers(df).collect()] == [10_485_761]


def test_suspicious_communication_private_ranges(spark):
    base = dict(src_ip="10.0.0.5", bidirectional_packets=51)
    rows = [dict(base, dst_ip="172.15.0.1"), dict(base, dst_ip="172.16.0.1"), dict(base, dst_ip="172.31.0.1"),
            dict(base, dst_ip="172.32.0.1"), dict(base, dst_ip="2001:db8::1"), dict(base, dst_ip="8.8.8.8"),
            dict(src_ip="10.0.0.5", dst_ip="45.1.1.1", bidirectional_packets=50),
            dict(src_ip="45.1.1.1", dst_ip="46.1.1.1", bidirectional_packets=99)]
    got = sorted(r.dst_ip for r in det.suspicious_communication(flows_df(spark, rows)).collect())
    assert got == ["172.15.0.1", "172.32.0.1", "2001:db8::1"]


def test_port_scan_ports_and_targets(spark):
    rows = ([dict(src_ip="s1", dst_ip=f"t{i % 4}", dst_port=i, bidirectional_packets=1) for i in range(51)]
            + [dict(src_ip="s2", dst_ip=f"t{i % 5}", dst_port=i, bidirectional_packets=1) for i in range(51)]
            + [dict(src_ip="s3", dst_ip="t", dst_port=i % 50, bidirectional_packets=1) for i in range(80)])
    got = det.port_scan(flows_df(spark, rows)).collect()
    assert [(r.src_ip, r.ports, r.targets, r.packets) for r in got] == [("s1", 51, 4, 51)]


def test_plugin_port_scan(spark):
    rows = ([dict(src_ip="s1", dst_port=p) for p in range(1, 16)] + [dict(src_ip="s1", dst_port=0)]
            + [dict(src_ip="s2", dst_port=p) for p in range(1, 15)] + [dict(src_ip="", dst_port=p) for p in range(1, 40)])
    got = det.plugin_port_scan(flows_df(spark, rows), threshold=15).collect()
    assert len(got) == 1 and got[0].src_ip == "s1" and got[0].port_count == 15
    assert got[0].confidence == 0.5
    assert got[0].sample_ports == ",".join(str(p) for p in range(1, 16))


def test_threat_domain_suffix_match(spark):
    rows = [dict(application_name="DNS", requested_server_name="a.evil.com.", src_ip="10.0.0.1"),
            dict(application_name="DNS", requested_server_name="evil.com", src_ip="10.0.0.2"),
            dict(application_name="DNS", requested_server_name="notevil.com", src_ip="10.0.0.3"),
            dict(application_name="DNS", requested_server_name="x.b.EVIL.com", src_ip="10.0.0.3"),
            dict(application_name="HTTP", requested_server_name="evil.com", src_ip="10.0.0.4")]
    ind = spark.createDataFrame([("EVIL.com",), ("b.evil.com",)], "value string")
    got = {r.domain: (r.matched_threat_domain, r.query_count, r.source_ips)
           for r in det.threat_domains(flows_df(spark, rows), ind).collect()}
    assert got == {"a.evil.com.": ("evil.com", 1, "10.0.0.1"), "evil.com": ("evil.com", 1, "10.0.0.2"),
                   "x.b.EVIL.com": ("b.evil.com", 1, "10.0.0.3")}


def test_domain_stats_first_ten_sources(spark):
    rows = [dict(application_name="DNS", requested_server_name="z.xyz", src_ip=f"10.0.0.{i}") for i in range(30)]
    names = spark.createDataFrame([("z.xyz",)], "domain string")
    r = det.domain_query_stats(det.dns_flows(flows_df(spark, rows)), names).collect()[0]
    assert r.query_count == 30
    assert r.source_ips == ",".join(sorted(f"10.0.0.{i}" for i in range(30))[:10])


def test_unknown_domains_rule_branch(spark):
    rows = [dict(application_name="DNS", requested_server_name="x7k2m9q4p8w3z6.tk", src_ip="1.1.1.1"),
            dict(application_name="DNS", requested_server_name="x7k2m9q4.tk", src_ip="1.1.1.1"),  # 0.4 only
            dict(application_name="DNS", requested_server_name="www.google.com", src_ip="1.1.1.1")]
    got = det.unknown_domains(flows_df(spark, rows)).collect()
    assert [(r.domain, r.ml_score, r.severity) for r in got] == [("x7k2m9q4p8w3z6.tk", 0.0, "MEDIUM")]


def test_safe_domain_suppression_is_optional(spark):
    rows = [dict(application_name="DNS", requested_server_name="abc1def2ghi3jkl.evil.com", src_ip="10.0.0.1"),
            dict(application_name="DNS", requested_server_name="q9w8e7r6t5y4u3.top", src_ip="10.0.0.1")]
    df = flows_df(spark, rows)
    safe = spark.createDataFrame([("evil.com",)], "value string")
    ind = spark.createDataFrame([("evil.com",)], "value string")
    assert det.threat_domains(df, ind).count() == 1
    assert det.threat_domains(df, ind, safe_domains=safe).count() == 0
    assert {r.domain for r in det.dga_domains(df, min_length=5, safe_domains=safe).collect()} == {"q9w8e7r6t5y4u3.top"}
    assert det.unknown_domain_names(df, safe_domains=safe).count() == det.unknown_domain_names(df).count()
