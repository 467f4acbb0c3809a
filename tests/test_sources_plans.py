"""Flow scan (S1), sinks (S11-S13, F15), full analysis (X6), late rows (T5), catalog without Spark."""

import os
import subprocess
import sys
import tempfile

from conftest import SF0001
from pyspark.sql import functions as F

from netsift.schema import FLOW_SCHEMA
from netsift.sources import sinks
from netsift.sources.flows import conform, load_tables, read_flows


def test_read_flows_formats_and_missing_columns(spark):
    d = tempfile.mkdtemp(prefix="netsift-flows-")
    df = spark.createDataFrame([("1.1.1.1", "2.2.2.2", 53, "DNS", 10)],
                               "src_ip string, dst_ip string, dst_port long, application_name string, bidirectional_bytes long")
    df.write.parquet(f"{d}/p")
    df.write.option("header", "true").csv(f"{d}/c")
    df.write.json(f"{d}/j")
    for fmt, path in (("parquet", f"{d}/p"), ("csv", f"{d}/c"), ("json", f"{d}/j")):
        out = read_flows(spark, path, fmt)
        assert out.schema == FLOW_SCHEMA
        r = out.collect()[0]
        assert (r.dst_port, r.bidirectional_bytes, r.user_agent) == (53, 10, None), fmt
    empty = read_flows(spark, f"{d}/p").limit(0)
    assert empty.count() == 0 and empty.schema == FLOW_SCHEMA
    assert conform(spark.range(2)).schema == FLOW_SCHEMA


def test_result_json_and_document(spark):
    from netsift.operators import flows as fl
    from netsift.plans.registry import Context, default_registry
    t = load_tables(spark, SF0001)
    alerts, _ = default_registry().run_all(t.flows, Context(spark, threat_domains=t.threat_domains))
    ips = spark.createDataFrame([(f"9.9.9.{i}", 50, "cache") for i in range(60)], "ip string, abuse_score int, origin string")
    path = os.path.join(tempfile.mkdtemp(prefix="netsift-report-"), "r")
    sinks.write_result_json(path, fl.traffic_summary(t.flows), alerts, ips)
    assert spark.read.json(f"{path}/findings").count() == 100
    assert spark.read.json(f"{path}/malicious_ips").count() == 50
    doc = sinks.result_document(fl.traffic_summary(t.flows)).collect()[0].json
    assert doc.startswith('{"total_flows":')


def test_pipeline_model_roundtrip(spark):
    from netsift.operators import domain_model as dm
    names = [f"n{i}.example.org" for i in range(20)] + [f"{i:06x}{i * 31:06x}zz.xyz" for i in range(20)]
    lab = spark.createDataFrame([(n, float(n.endswith(".xyz"))) for n in names], "domain string, label double")
    model = dm.train(lab, trees=5, depth=2)
    path = os.path.join(tempfile.mkdtemp(prefix="netsift-model-"), "m")
    sinks.save_model(model, path)
    again = sinks.load_pipeline_model(path)
    a = sorted((r.domain, r.probability) for r in dm.score(model, lab).collect())
    b = sorted((r.domain, r.probability) for r in dm.score(again, lab).collect())
    assert a == b


def test_full_analysis(spark):
    from netsift.operators import reputation as rp
    from netsift.plans.analysis import analyze
    from netsift.plans.registry import Context, default_registry
    t = load_tables(spark, SF0001)
    res = analyze(t.flows, Context(spark, threat_domains=t.threat_domains), registry=default_registry(fused_scan=True),
                  domain_reputation=t.domain_reputation, ip_cache=rp.cache_from_snapshot(t.ip_reputation),
                  ip_service=t.ip_reputation, materialize=True)
    assert {r.name for r in res["reports"]} == {"dns_threat_detector", "http_threat_detector", "covert_channel_detector", "behavioral_anomaly_detector"}
    types = {r.threat_type: r.alert_count for r in res["type_counts"].collect()}
    assert types.get("PORT_SCAN") == 1 and "DNS_TUNNEL" in types
    sev = res["severity_counts"].collect()[0]
    assert sev.high_count + sev.medium_count + sev.low_count == res["alerts"].count()
    assert res["summary"].collect()[0].total_flows == t.flows.count()
    assert "is_anomaly" in res["flows"].columns


def test_late_rows_are_dropped_past_the_watermark(spark):
    from netsift.schema import FLOW_SCHEMA as S
    from netsift.sources.flows import read_flow_stream
    from netsift.streaming import detectors as sd
    d = tempfile.mkdtemp(prefix="netsift-late-")
    src, out, ck = f"{d}/in", f"{d}/out", f"{d}/ck"
    hour = 3600 * 1000

    def batch(ts_list, name):
        rows = [{f.name: None for f in S.fields} | dict(application_name="DNS", dst_ip="8.8.8.8",
                                                       bidirectional_packets=30, bidirectional_first_seen_ms=ts)
                for ts in ts_list]
        spark.createDataFrame(rows, S).coalesce(1).write.mode("append").parquet(f"{src}/{name}")
    batch([10 * hour], "a")
    stream = read_flow_stream(spark, f"{src}/*", max_files_per_trigger=1)
    q = sd.tumbling_dns_tunnel(stream, watermark="10 minutes")
    sd.run_upsert(q, out, ck)
    batch([0], "b")                      # 10 hours late: behind the watermark
    sd.run_upsert(sd.tumbling_dns_tunnel(read_flow_stream(spark, f"{src}/*", max_files_per_trigger=1),
                                         watermark="10 minutes"), out, ck)
    got = {r.window_start_ms for r in sd.read_latest(spark, out, ["window_start_ms", "dst_ip"]).collect()}
    assert got == {10 * hour}


def test_catalog_builds_without_spark():
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as se; "
            "q = se.queries(); o = se.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))"
            % os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def test_kafka_reader_needs_the_connector(spark):
    import pytest

    from netsift.sources.flows import read_flow_stream_kafka
    with pytest.raises(Exception):
        read_flow_stream_kafka(spark, "localhost:9", "flows")  # connector absent here: fails before any I/O
