"""Graph (P7, P8, A14, J10, J11, G1-G5), alert tables (U1, A10-A12) and the registry."""

from conftest import flows_df
from pyspark.sql import functions as F

from netsift.functions import ip as ipf
from netsift.operators import alerts as al
from netsift.operators import graph as gr
from netsift.plans.registry import Context, Detector, default_registry


def test_ip_predicates(spark):
    ips = ["0.0.0.0", "255.255.255.255", "127.0.0.1", "10.0.0.255", "224.0.0.1", "169.254.1.1", "240.0.0.1",
           "8.8.8.8", "127.0.0.2", "", None, "not-an-ip", "01.2.3.4", "2001:db8::1", "192.168.1.1", "192.168.1.254",
           "10.0.0.7", "114.114.114.114", "203.0.113.5", "100.64.0.1"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    rows = df.select("ip", ipf.is_graph_valid_ip("ip").alias("v"), ipf.ip_category("ip").alias("c"),
                     ipf.is_external_ip("ip").alias("e")).collect()
    valid = {r.ip for r in rows if r.v}
    assert valid == {"8.8.8.8", "127.0.0.2", "2001:db8::1", "192.168.1.1", "192.168.1.254", "10.0.0.7",
                     "114.114.114.114", "203.0.113.5", "100.64.0.1"}
    cat = {r.ip: r.c for r in rows}
    assert cat["192.168.1.1"] == "Gateway/Router" and cat["192.168.1.254"] == "Gateway/Router"
    assert cat["10.0.0.7"] == "Internal Host" and cat["114.114.114.114"] == "Public DNS"
    assert cat["203.0.113.5"] == "Internal Host" and cat["100.64.0.1"] == "External Server"
    ext = {r.ip for r in rows if r.e}
    assert ext == {"8.8.8.8", "114.114.114.114", "224.0.0.1", "100.64.0.1"}


def _flows(spark):
    return flows_df(spark, [
        dict(src_ip="10.0.0.1", dst_ip="8.8.8.8", bidirectional_bytes=600, application_name="DNS",
             requested_server_name="a.Bad.com"),
        dict(src_ip="10.0.0.1", dst_ip="8.8.8.8", bidirectional_bytes=600, application_name="TLS"),
        dict(src_ip="10.0.0.2", dst_ip="1.2.3.4", bidirectional_bytes=500_000, application_name=""),
        dict(src_ip="10.0.0.3", dst_ip="10.0.0.255", bidirectional_bytes=9_999_999),
        dict(src_ip="10.0.0.4", dst_ip="5.6.7.8", bidirectional_bytes=10)])


def test_full_graph(spark):
    g = gr.build_graph(_flows(spark), min_bytes=1000)
    e = {(r.source, r.target): (r.value, r.label, r.width) for r in g["edges"].collect()}
    assert e == {("10.0.0.1", "8.8.8.8"): (1200, "DNS, TLS", 1.0012), ("10.0.0.2", "1.2.3.4"): (500000, "", 1.5)}
    n = {r.id: (r.category, r.value, r.show_label) for r in g["nodes"].collect()}
    assert n["8.8.8.8"] == ("Public DNS", 1200, False) and n["1.2.3.4"] == ("External Server", 500000, True)


def test_threat_graph(spark):
    ips = spark.createDataFrame([("1.2.3.4",)], "value string")
    doms = spark.createDataFrame([("bad.com",)], "value string")
    g = gr.build_graph(_flows(spark), min_bytes=0, highlight_ips=ips, highlight_domains=doms)
    e = {(r.source, r.target, r.kind) for r in g["edges"].collect()}
    assert e == {("10.0.0.1", "8.8.8.8", "ip"), ("10.0.0.2", "1.2.3.4", "ip"), ("10.0.0.1", "bad.com", "domain")}
    n = {r.id: (r.category, r.is_bad_actor) for r in g["nodes"].collect()}
    assert n["10.0.0.1"] == ("Threat Node", True) and n["1.2.3.4"] == ("Threat Node", True)
    assert n["bad.com"] == ("Domain", False) and n["8.8.8.8"] == ("Public DNS", False)


def test_alert_iocs(spark):
    from netsift.schema import ALERT_SCHEMA
    rows = [("e", "PHISHING", "HIGH", "Hit Evil.Example.com from 10.1.1.1", {"domain": "Mixed.Case.org", "n": "5"},
             0.9, ["evil.example.com", "9.9.9.9"], None, None),
            ("e", "DNS_TUNNEL", "HIGH", "no iocs", {"ips": "1.1.1.1,2.2.2.2"}, 0.7, ["x"], None, None)]
    a = spark.createDataFrame(rows, ALERT_SCHEMA)
    out = gr.alert_iocs(a)
    assert {r.value for r in out["ips"].collect()} == {"10.1.1.1", "9.9.9.9", "1.1.1.1", "2.2.2.2"}
    assert {r.value for r in out["domains"].collect()} == {"evil.example.com", "mixed.case.org", "Mixed.Case.org"}


def test_alert_counts(spark):
    from netsift.schema import ALERT_SCHEMA
    rows = [("x", "MALICIOUS_IP", "HIGH", "d", {}, 0.9, [], None, None),
            ("y", "UNKNOWN_DOMAIN", "LOW", "d", {}, 0.5, [], None, None),
            (None, "DNS_TUNNEL", "HIGH", "d", {}, 0.7, [], None, None)]
    a = spark.createDataFrame(rows, ALERT_SCHEMA)
    r = al.severity_counts(a).collect()[0]
    assert (r.high_count, r.medium_count, r.low_count) == (2, 0, 1)
    assert {r.engine_name: r.alert_count for r in al.counts_by(a, "engine_name").collect()} == {
        "x": 1, "y": 1, "unknown": 1}
    assert al.select_alerts(a, severity="HIGH").count() == 2
    assert al.select_alerts(a, threat_type="DNS_TUNNEL").count() == 1
    many = a.crossJoin(spark.range(250)).drop("id")
    assert {r.threat_type: r["count"] for r in al.alert_bundle(many).groupBy("threat_type").count().collect()} == {
        "MALICIOUS_IP": 250, "UNKNOWN_DOMAIN": 250, "DNS_TUNNEL": 250}


def test_registry_failures_and_toggles(spark, tmp_path):
    flows = _flows(spark)
    ctx = Context(spark, threat_domains=spark.createDataFrame([("bad.com",)], "value string"))
    reg = default_registry()

    def broken(df, c, cfg):
        return df.select(F.col("no_such_column"))
    reg.register(Detector("broken", broken, priority=5))
    alerts, reports = reg.run_all(flows, ctx)
    status = {r.name: r.status for r in reports}
    assert status["broken"] == "error" and status["dns_threat_detector"] == "ok"
    assert alerts.where("threat_type = 'PHISHING'").count() == 1
    reg.disable("dns_threat_detector")
    alerts2, reports2 = reg.run_all(flows, ctx)
    assert {r.name: r.status for r in reports2}["dns_threat_detector"] == "disabled"
    assert alerts2.where("engine_name = 'dns_threat_detector'").count() == 0
    assert reg.unregister("broken") and not reg.unregister("broken")
    stats = {r.name: r.health for r in reg.run_statistics(flows, ctx, str(tmp_path)).collect()}
    assert stats["dns_threat_detector"] == "disabled" and stats["http_threat_detector"] == "healthy"


def test_fused_equals_union(spark):
    from conftest import SF0001
    from netsift.operators import fused
    from netsift.sources.flows import load_tables
    t = load_tables(spark, SF0001)
    ctx = Context(spark, threat_domains=t.threat_domains)
    a, _ = default_registry().run_all(t.flows, ctx)
    b, _ = default_registry(fused_scan=True).run_all(t.flows, ctx)
    cols = ["engine_name", "threat_type", "severity", "description", "confidence", "priority"]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
    assert b.select(*cols).exceptAll(a.select(*cols)).count() == 0
    assert fused.per_flow_alerts(t.flows).count() > 0
    reg = default_registry(fused_scan=True)
    assert reg.disable("http_threat_detector")
    c, _ = reg.run_all(t.flows, ctx)
    assert c.where("engine_name = 'http_threat_detector'").count() == 0
    assert c.select(*cols).exceptAll(a.select(*cols)).count() == 0


def test_tls_rule_without_the_confidence_column(spark):
    """A source without the column: every TLS flow counts; with it and NULLs: none does."""
    from netsift.sources.flows import conform
    rows = [("9.9.9.9", "TLS", None)] * 5
    plain = spark.createDataFrame([r[:2] for r in rows], "dst_ip string, application_name string")
    nulls = spark.createDataFrame(rows, "dst_ip string, application_name string, application_confidence int")
    for fused_scan in (False, True):
        run = lambda f, s=fused_scan: default_registry(s).run_all(conform(f), Context(spark, source_columns=f.columns))[0]
        assert run(plain).where("threat_type = 'UNKNOWN_TLS'").count() == 1
        assert run(nulls).where("threat_type = 'UNKNOWN_TLS'").count() == 0


def test_other_errors_are_not_swallowed(spark):
    import pytest

    def lost(df, c, cfg):
        raise RuntimeError("executor lost")
    reg = default_registry()
    reg.register(Detector("lost", lost))
    with pytest.raises(RuntimeError):
        reg.run_all(_flows(spark), Context(spark))


def test_empty_highlight_sets_give_the_whole_graph(spark):
    from conftest import SF0001
    from netsift.operators import graph as g
    from netsift.sources.flows import load_tables
    flows = load_tables(spark, SF0001).flows
    none = spark.createDataFrame([], "value string")
    whole = g.build_graph(flows, min_bytes=0)["edges"].count()
    assert whole > 0 and g.build_graph(flows, highlight_ips=none, highlight_domains=none)["edges"].count() == whole
    one = spark.createDataFrame([("no.such.name",)], "value string")
    assert g.build_graph(flows, highlight_ips=none, highlight_domains=one)["edges"].count() == 0


def test_top_k_per_group_is_exact_under_a_hot_group(spark):
    from netsift.operators.topk import top_k_per_group
    rows = [("hot", i) for i in range(5000)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = top_k_per_group(df, ["g"], [F.desc("v")], 7, salts=16, rank_col="rank")
    res = {(r.g, r.rank): r.v for r in got.collect()}
    assert [res[("hot", i)] for i in range(1, 8)] == list(range(4999, 4992, -1))
    assert [res[("cold", i)] for i in range(1, 4)] == [2, 1, 0]
