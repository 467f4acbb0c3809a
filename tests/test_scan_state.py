"""The state of the exact sliding scan (T3) grows with the pairs met, not with pairs times windows."""

import os
import tempfile

from conftest import flows_df
from pyspark.sql import functions as F

from netsift.sources.flows import read_flow_stream
from netsift.streaming import detectors as sd

BASE = 1_699_999_980_000  # a whole minute


def _run(spark, rows, **kw):
    d = tempfile.mkdtemp(prefix="netsift-stream-")
    src, out, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    flows_df(spark, rows).coalesce(1).write.parquet(src)
    sd.use_rocksdb_state(spark)
    q = sd.exact_port_scan(read_flow_stream(spark, src), "10 minutes", "1 minute", "1 minute", **kw) \
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out), q.recentProgress


def test_state_rows_do_not_grow_with_the_windows(spark):
    rows = [dict(src_ip="10.0.0.1", dst_ip=f"9.9.9.{i % 40}", dst_port=i % 50, bidirectional_packets=1,
                 bidirectional_first_seen_ms=BASE + i * 1000) for i in range(1800)]
    got, progress = _run(spark, rows, parts=8)
    state = max(sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress)
    windows = 1800 // 60 + 10
    assert state <= 8 + windows  # parts, and the open windows of one source; (window, port or target) were 3,600
    full = got.where((F.col("ports") == 50) & (F.col("targets") == 40) & (F.col("packets") == 600)).count()
    assert full == (1799 - 60) // 60 - 9  # windows that lie in the data and were closed


def test_values_that_are_null_and_pairs_that_return(spark):
    at = lambda minute, **kw: dict(src_ip="10.0.0.1", bidirectional_first_seen_ms=BASE + minute * 60_000, **kw)
    rows = [at(0, dst_ip="a", dst_port=1), at(3, bidirectional_packets=7), at(12, dst_ip="a", dst_port=1, bidirectional_packets=2),
            at(40, dst_ip="b"), dict(dst_ip="c", bidirectional_first_seen_ms=BASE + 50 * 60_000)]
    got, _ = _run(spark, rows, parts=2)
    minute = lambda w: (w - BASE) // 60_000
    got = {minute(r.window_start_ms): (r.ports, r.targets, r.packets) for r in got.collect()}
    assert {w: got[w] for w in (-9, -6, 0, 1, 3, 4, 12)} == {-9: (1, 1, None), -6: (1, 1, 7), 0: (1, 1, 7), 1: (0, 0, 7),
                                                             3: (1, 1, 9), 4: (1, 1, 2), 12: (1, 1, 2)}
    assert max(got) == 12 and len(got) == 22  # closed at minute 39: no window of the flow at 40
