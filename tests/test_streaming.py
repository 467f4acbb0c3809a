"""Streaming forms (T1-T6): drained streams equal the batch operators."""

import os
import tempfile

from conftest import SF0001
from pyspark.sql import functions as F

from netsift.operators import alerts as al
from netsift.operators import detectors as det
from netsift.operators import fused
from netsift.sources.flows import load_tables, read_flow_stream
from netsift.streaming import detectors as sd


def _dirs():
    d = tempfile.mkdtemp(prefix="netsift-stream-")
    return os.path.join(d, "in"), os.path.join(d, "out"), os.path.join(d, "ck")


def test_stateless_stream_equals_batch(spark):
    t = load_tables(spark, SF0001)
    src, out, ck = _dirs()
    t.flows.repartition(3).write.parquet(src)
    sd.run_append(sd.stateless_alerts(read_flow_stream(spark, src, max_files_per_trigger=1)), out, ck)
    got = al.ioc_string(spark.read.parquet(out))
    exp = al.ioc_string(fused.per_flow_alerts(t.flows))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_tumbling_window_upsert_equals_batch(spark):
    t = load_tables(spark, SF0001)
    src, out, ck = _dirs()
    t.flows.write.parquet(src)
    sd.run_upsert(sd.tumbling_dns_tunnel(read_flow_stream(spark, src)), out, ck)
    got = sd.read_latest(spark, out, ["window_start_ms", "dst_ip"])
    ws = (F.floor(F.col("bidirectional_first_seen_ms") / 300000) * 300000).cast("bigint")
    exp = (det.dns_flows(t.flows).where(F.col("dst_ip").isNotNull()).groupBy(ws.alias("window_start_ms"), "dst_ip")
           .agg(F.sum("bidirectional_packets").cast("bigint").alias("packet_count"))
           .where(F.col("packet_count") > det.DNS_TUNNEL_PACKETS))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_sliding_scan_takes_back_a_window_that_stops_being_one(spark):
    """First 200 ports on one target (a scan), then 60 more targets in the same window (none any more)."""
    import time

    from conftest import flows_df
    base = 1_700_000_000_000
    flow = lambda port, dst, ms: dict(src_ip="10.0.0.1", dst_ip=dst, dst_port=port, bidirectional_packets=1,
                                      bidirectional_first_seen_ms=base + ms)
    src, out, ck = _dirs()
    parts = [[flow(1000 + i, "9.9.9.9", i) for i in range(200)], [flow(80, f"9.9.8.{i}", 300 + i) for i in range(60)],
             [flow(81, "9.9.7.1", 400)]]
    key = ["window_start_ms", "src_ip"]
    scans = []
    for part in parts:
        flows_df(spark, part).coalesce(1).write.mode("append").parquet(src)
        sd.run_upsert(sd.sliding_port_scan(read_flow_stream(spark, src)), out, ck)
        scans.append(sd.scan_windows(sd.read_latest(spark, out, key)).count())
        time.sleep(1.1)
    assert scans[0] > 0 and scans[1:] == [0, 0]


def test_read_latest_lets_errors_out(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException
    assert sd.read_latest(spark, f"{tmp_path}/none", ["a"], "a int, batch_id long").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception) as e:
        sd.read_latest(spark, f"{tmp_path}/bad", ["a"], "a int").count()
    assert not (isinstance(e.value, AnalysisException) and e.value.getCondition() == "PATH_NOT_FOUND")


def test_static_join_each_batch(spark):
    t = load_tables(spark, SF0001)
    src, out, ck = _dirs()
    t.flows.write.parquet(src)
    doms = t.threat_domains
    sd.static_join_each_batch(read_flow_stream(spark, src), lambda s: doms, sd.threat_domain_hits, out, ck)
    got = {(r.domain, r.matched_threat_domain) for r in spark.read.parquet(out).collect()}
    exp = {(r.domain, r.matched_threat_domain) for r in det.threat_domains(t.flows, doms).collect()}
    assert got == exp and got


def test_stateful_metering_equals_batch(spark):
    import time

    from pyspark.sql import functions as F

    from netsift.operators import metering as mt
    from netsift.schema import PACKET_SCHEMA
    A, B = ("10.0.0.1", 5000), ("8.8.8.8", 53)
    rows = [(B, A, 0, 10), (A, B, 50, 20), (B, A, 100, 30), (A, B, 200, 40), (A, B, 260, 50),
            (A, B, 330, 60), (B, A, 340, 70), (A, B, 1000, 5)]
    base = 1_700_000_000_000  # event times at epoch 0 would sit on Spark's initial watermark
    data = [(i, s[0], d[0], s[1], d[1], 17, base + ts, ln) for i, (s, d, ts, ln) in enumerate(rows)]
    src, out, ck = _dirs()
    for part in (data[:4], data[4:]):                      # two files, in time order
        spark.createDataFrame(part, PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)

    def drain():
        s = spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        sd.run_append(sd.stateful_metering(s, idle_ms=100, active_ms=120, watermark="0 seconds"), out, ck)
    drain()
    sd.flush_sessions(spark, src, base + 1000, 100, 0)
    drain()
    got = spark.read.parquet(out).where(F.col("src_ip") != sd.HEARTBEAT_IP)
    exp = mt.meter(spark.createDataFrame(data, PACKET_SCHEMA), 100, 120).select(*got.columns)
    key = ["bidirectional_first_seen_ms", "bidirectional_packets", "bidirectional_bytes", "src_ip",
           "src2dst_bytes", "dst2src_bytes", "bidirectional_mean_piat_ms"]
    assert sorted(tuple(r) for r in got.select(*key).collect()) == sorted(tuple(r) for r in exp.select(*key).collect())
    assert got.count() == 4


def test_stateful_metering_late_packets_are_flows_of_their_own(spark):
    import time

    from pyspark.sql import functions as F

    from netsift.schema import PACKET_SCHEMA
    base = 1_700_000_000_000
    row = lambda i, ts: (i, "10.0.0.1", "8.8.8.8", 5000, 53, 17, base + ts, 10)
    src, out, ck = _dirs()
    for part in ([row(0, 5000), row(1, 5500)], [row(2, 5200)], [row(3, 5600)]):
        spark.createDataFrame(part, PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)

    def drain():
        s = spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        sd.run_append(sd.stateful_metering(s, idle_ms=1000, active_ms=100_000, watermark="10 seconds"), out, ck)
    drain()
    sd.flush_sessions(spark, src, base + 6000, 1000, 10_000)
    drain()
    got = spark.read.parquet(out).where(F.col("src_ip") != sd.HEARTBEAT_IP).collect()
    assert sorted((r.bidirectional_first_seen_ms - base, r.bidirectional_last_seen_ms - base, r.bidirectional_packets) for r in got) == [
        (5000, 5600, 3), (5200, 5200, 1)]


def test_exact_scan_counts_equal_the_batch(spark):
    """Ports and targets that come again, in one file or a later one, count once; closed windows go out once."""
    import random
    import time

    from conftest import flows_df
    rng = random.Random(3)
    base = 1_699_999_980_000  # a whole minute
    rows = [dict(src_ip=rng.choice(["10.0.0.1", "10.0.0.2", None]), dst_ip=f"9.9.9.{rng.randint(0, 6)}" if rng.random() < .9 else None,
                 dst_port=rng.randint(1, 60) if rng.random() < .9 else None, bidirectional_packets=rng.randint(1, 5),
                 bidirectional_first_seen_ms=base + i * 500) for i in range(1200)]
    src, out, ck = _dirs()
    for part in (rows[:600], rows[600:]):
        flows_df(spark, part).coalesce(1).write.mode("append").parquet(src)
        sd.run_append(sd.exact_port_scan(read_flow_stream(spark, src), "2 minutes", "1 minute", "30 seconds"), out, ck)
        time.sleep(1.1)
    want = {}
    closed = max(r["bidirectional_first_seen_ms"] for r in rows if r["src_ip"]) - 30_000
    for r in rows:
        ts = r["bidirectional_first_seen_ms"]
        for w in (ts - ts % 60_000, ts - ts % 60_000 - 60_000):
            if r["src_ip"] and w + 120_000 <= closed:
                ports, targets, packets = want.setdefault((w, r["src_ip"]), (set(), set(), []))
                ports.add(r["dst_port"])
                targets.add(r["dst_ip"])
                packets.append(r["bidirectional_packets"])
    want = sorted((*k, len(p - {None}), len(t - {None}), sum(n)) for k, (p, t, n) in want.items())
    got = [tuple(r) for r in spark.read.parquet(out).select("window_start_ms", "src_ip", "ports", "targets", "packets").collect()]
    assert sorted(got) == want and len(want) >= 14
