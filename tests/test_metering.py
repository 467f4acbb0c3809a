"""Flow metering (S2): idle / active timeouts, direction, inter-arrival times, bucket independence."""

from netsift.operators import metering as mt
from netsift.schema import PACKET_SCHEMA

A, B = ("10.0.0.1", 5000), ("8.8.8.8", 53)


def pk(spark, rows):
    data = [(i, s[0], d[0], s[1], d[1], 17, ts, ln) for i, (s, d, ts, ln) in enumerate(rows)]
    return spark.createDataFrame(data, PACKET_SCHEMA)


def test_idle_active_and_direction(spark):
    rows = [(B, A, 0, 10),        # first packet from B: B is the initiator
            (A, B, 50, 20),
            (B, A, 100, 30),      # gap 50 < idle 100
            (A, B, 200, 40),      # gap 100 >= idle -> new flow, initiator A
            (A, B, 260, 50),
            (A, B, 330, 60),      # 330 - 200 >= active 120 -> new piece, initiator A
            (B, A, 340, 70)]
    for bucket in (30, 100, 1000):
        got = sorted(mt.meter(pk(spark, rows), idle_ms=100, active_ms=120, bucket_ms=bucket).collect(),
                     key=lambda r: r.bidirectional_first_seen_ms)
        assert [(r.src_ip, r.bidirectional_packets, r.bidirectional_bytes) for r in got] == [
            ("8.8.8.8", 3, 60), ("10.0.0.1", 2, 90), ("10.0.0.1", 2, 130)], bucket
        f0, f1, f2 = got
        assert (f0.src2dst_packets, f0.dst2src_packets, f0.src2dst_bytes, f0.dst2src_bytes) == (2, 1, 40, 20)
        assert f0.bidirectional_mean_piat_ms == 50.0 and f0.bidirectional_stddev_piat_ms == 0.0
        assert f0.bidirectional_duration_ms == 100.0 and f0.bidirectional_mean_ps == 20.0
        assert f1.bidirectional_mean_piat_ms == 60.0 and f2.bidirectional_mean_piat_ms == 10.0
        assert f2.src_port == 5000 and f2.dst_port == 53


def test_single_packet_flow(spark):
    r = mt.meter(pk(spark, [(A, B, 5, 99)])).collect()[0]
    assert (r.bidirectional_packets, r.bidirectional_stddev_ps, r.bidirectional_mean_piat_ms) == (1, 0.0, 0.0)
