"""Flow metering (S2): packets → bidirectional flows.

Definition (idle / active timeouts as in the reference's metering settings):

- packets are keyed by the canonical 5-tuple (lower endpoint first), ordered
  by (ts_ms, packet_id);
- a new flow starts at the first packet of a key and at every packet whose
  gap to the previous packet of the key is >= ``idle_ms``;
- a flow longer than ``active_ms`` is cut into pieces
  ``floor((ts - flow_start) / active_ms)``;
- src/dst follow the first packet of each piece; ``*_piat_ms`` are the gaps
  between consecutive packets of the piece; deviations are sample deviations
  (0 for a single value).

Skew: a plain window per 5-tuple puts a hot tuple (one long connection with
a third of all packets) into one task. Here packets are windowed per
(5-tuple, time bucket); what crosses a bucket edge (the previous packet's
time and the current flow start) comes from small per-bucket summaries
windowed per 5-tuple, joined back on (5-tuple, bucket). The final aggregate
is a partial/final HashAggregate, so no step holds a whole hot tuple.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.schema import FLOW_SCHEMA
from netsift.sources.flows import conform

# --- fixed values (reference defaults, seconds → ms) ------------------------------
IDLE_TIMEOUT_MS = 120 * 1000
ACTIVE_TIMEOUT_MS = 1800 * 1000
DEFAULT_BUCKET_MS = 3600 * 1000
# ------------------------------------------------------------------------------------

KEY = ["a_ip", "a_port", "b_ip", "b_port", "protocol"]


def canonical(packets: DataFrame) -> DataFrame:
    """Add the canonical endpoint pair (a = lower (ip, port), b = the other)."""
    s_first = (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip"))
                                                     & (F.col("src_port") <= F.col("dst_port")))
    return packets.select(
        "*",
        F.when(s_first, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("a_ip"),
        F.when(s_first, F.col("src_port")).otherwise(F.col("dst_port")).alias("a_port"),
        F.when(s_first, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("b_ip"),
        F.when(s_first, F.col("dst_port")).otherwise(F.col("src_port")).alias("b_port"),
        s_first.alias("a_to_b"))


def meter(packets: DataFrame, idle_ms: int = IDLE_TIMEOUT_MS, active_ms: int = ACTIVE_TIMEOUT_MS,
          bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """FLOW_SCHEMA rows from a packet table (PACKET_SCHEMA)."""
    p = canonical(packets.where(F.col("ts_ms").isNotNull())).withColumn(
        "bucket", F.floor(F.col("ts_ms") / bucket_ms).cast("bigint"))
    kb = KEY + ["bucket"]
    order = [F.col("ts_ms"), F.col("packet_id")]
    w_in = Window.partitionBy(*kb).orderBy(*order)
    # 1. previous packet inside the (key, bucket) partition
    p = p.withColumn("prev_ts", F.lag("ts_ms").over(w_in))
    # 2. bucket summaries: last packet time per bucket, carried to the next bucket
    summ = p.groupBy(*kb).agg(F.max("ts_ms").alias("b_max"))
    w_b = Window.partitionBy(*KEY).orderBy("bucket")
    summ = summ.withColumn("before_ts", F.lag("b_max").over(w_b))
    p = p.join(summ.select(*kb, "before_ts"), kb)
    p = p.withColumn("prev_ts", F.coalesce("prev_ts", "before_ts"))
    p = p.withColumn("is_start", F.col("prev_ts").isNull() | (F.col("ts_ms") - F.col("prev_ts") >= idle_ms))
    # 3. flow start: last start at or before the packet; across buckets via the summaries
    start_here = F.when(F.col("is_start"), F.col("ts_ms"))
    w_run = w_in.rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("start_in", F.last(start_here, ignorenulls=True).over(w_run))
    starts = p.groupBy(*kb).agg(F.max(start_here).alias("b_last_start"))
    w_prev = w_b.rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("carried", F.last("b_last_start", ignorenulls=True).over(w_prev))
    p = p.join(starts.select(*kb, "carried"), kb)
    p = p.withColumn("flow_start", F.coalesce("start_in", "carried"))
    # 4. active-timeout pieces and inter-arrival times inside a piece
    piece = F.floor((F.col("ts_ms") - F.col("flow_start")) / active_ms)
    prev_piece = F.floor((F.col("prev_ts") - F.col("flow_start")) / active_ms)
    p = p.withColumn("piece", piece.cast("bigint")).withColumn(
        "piat", F.when(~F.col("is_start") & (prev_piece == F.col("piece")), F.col("ts_ms") - F.col("prev_ts")))
    # 5. one partial/final aggregate per flow piece
    ab = F.col("a_to_b")
    first = F.min_by(F.col("a_to_b"), F.struct(*order))
    g = p.groupBy(*KEY, "flow_start", "piece").agg(
        first.alias("init_a"),
        F.count(F.lit(1)).alias("n"),
        F.sum("len").alias("bytes"),
        F.count(F.when(ab, 1)).alias("ab_n"),
        F.coalesce(F.sum(F.when(ab, F.col("len"))), F.lit(0)).alias("ab_b"),
        F.count(F.when(~ab, 1)).alias("ba_n"),
        F.coalesce(F.sum(F.when(~ab, F.col("len"))), F.lit(0)).alias("ba_b"),
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.avg("len").alias("mean_ps"), F.stddev_samp("len").alias("std_ps"),
        F.avg("piat").alias("mean_piat"), F.stddev_samp("piat").alias("std_piat"))
    ia = F.col("init_a")
    out = g.select(
        F.when(ia, F.col("a_ip")).otherwise(F.col("b_ip")).alias("src_ip"),
        F.when(ia, F.col("b_ip")).otherwise(F.col("a_ip")).alias("dst_ip"),
        F.when(ia, F.col("a_port")).otherwise(F.col("b_port")).alias("src_port"),
        F.when(ia, F.col("b_port")).otherwise(F.col("a_port")).alias("dst_port"),
        "protocol",
        F.col("n").alias("bidirectional_packets"),
        F.when(ia, F.col("ab_n")).otherwise(F.col("ba_n")).alias("src2dst_packets"),
        F.when(ia, F.col("ba_n")).otherwise(F.col("ab_n")).alias("dst2src_packets"),
        F.col("bytes").alias("bidirectional_bytes"),
        F.when(ia, F.col("ab_b")).otherwise(F.col("ba_b")).alias("src2dst_bytes"),
        F.when(ia, F.col("ba_b")).otherwise(F.col("ab_b")).alias("dst2src_bytes"),
        F.col("first_ms").alias("bidirectional_first_seen_ms"),
        F.col("last_ms").alias("bidirectional_last_seen_ms"),
        (F.col("last_ms") - F.col("first_ms")).cast("double").alias("bidirectional_duration_ms"),
        F.col("mean_ps").alias("bidirectional_mean_ps"),
        F.coalesce("std_ps", F.lit(0.0)).alias("bidirectional_stddev_ps"),
        F.coalesce("mean_piat", F.lit(0.0)).alias("bidirectional_mean_piat_ms"),
        F.coalesce("std_piat", F.lit(0.0)).alias("bidirectional_stddev_piat_ms"))
    return conform(out, FLOW_SCHEMA)


METERED_COLUMNS = [f.name for f in FLOW_SCHEMA.fields
                   if f.name not in ("application_name", "application_confidence", "requested_server_name",
                                     "user_agent")]
