"""Structured Streaming forms of the detectors and metering.

- T1: per-flow detectors are one projection, unchanged on a stream.
- T2: tumbling D3 / D6 / D10 with a watermark on the flow start time.
- T3: sliding D14 with exact distinct counts: state with the windows in which
  each (source, port) and (source, target) was met, then a sum, in append mode
  (``exact_port_scan``); ``sliding_port_scan`` shows windows that are still
  open, by sketches.
- T4: packet sessions with ``session_window`` (idle gap); the active-time
  cap of batch metering needs timers and is only in the batch form.
- T5: rows later than the watermark are dropped by Spark; re-running the
  batch operator over the landed files is the correction path.
- T6: stream–static join where the static side (indicators) is re-read on
  every micro-batch inside ``foreachBatch``.

Aggregating sinks run in update mode and upsert each micro-batch into a
Parquet table (``batch_id`` column); ``read_latest`` returns the last version
of every key, which equals the batch result once the stream is drained.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from netsift.functions import domain as dom
from netsift.operators import detectors as det
from netsift.operators import fused

DEFAULT_WATERMARK = "10 minutes"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB (off-heap, spills to local disk, checkpointed
    to the shared checkpoint folder) unless the session already chose a provider.
    Windowed and session state grows with keys × open windows; the default
    in-heap provider holds all of it in executor memory."""
    key = "spark.sql.streaming.stateStore.providerClass"
    cur = spark.conf.get(key, None)
    if not cur or cur.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB_PROVIDER)


def with_event_time(flows: DataFrame, col: str = "bidirectional_first_seen_ms") -> DataFrame:
    return flows.withColumn("event_time", F.timestamp_millis(F.col(col)))


def stateless_alerts(flows: DataFrame) -> DataFrame:
    """The seven per-flow detectors on a stream (append mode)."""
    return fused.per_flow_alerts(flows)


def tumbling_dns_tunnel(flows: DataFrame, window: str = "5 minutes", watermark: str = DEFAULT_WATERMARK,
                        threshold: int = det.DNS_TUNNEL_PACKETS) -> DataFrame:
    """D3 per tumbling window."""
    f = with_event_time(det.dns_flows(flows)).withWatermark("event_time", watermark)
    return (f.where(F.col("dst_ip").isNotNull())
            .groupBy(F.window("event_time", window).alias("w"), "dst_ip")
            .agg(F.sum("bidirectional_packets").cast("bigint").alias("packet_count"))
            .where(F.col("packet_count") > threshold)
            .select(F.unix_millis(F.col("w.start")).alias("window_start_ms"), "dst_ip", "packet_count"))


def tumbling_uncommon_ports(flows: DataFrame, window: str = "5 minutes", watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """D6 per tumbling window."""
    f = with_event_time(flows).withWatermark("event_time", watermark)
    return (f.where(F.col("dst_port").isNotNull() & ~F.col("dst_port").isin(*det.COMMON_PORTS))
            .groupBy(F.window("event_time", window).alias("w"), F.col("dst_port").alias("port"))
            .agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > det.UNCOMMON_PORT_FLOWS)
            .select(F.unix_millis(F.col("w.start")).alias("window_start_ms"), "port", "count"))


def tumbling_unknown_tls(flows: DataFrame, window: str = "5 minutes", watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """D10 per tumbling window."""
    f = with_event_time(flows).withWatermark("event_time", watermark)
    return (f.where((F.col("application_name") == "TLS") & (F.col("application_confidence") < det.TLS_CONFIDENCE)
                    & F.col("dst_ip").isNotNull())
            .groupBy(F.window("event_time", window).alias("w"), "dst_ip")
            .agg(F.count(F.lit(1)).alias("flows")).where(F.col("flows") >= det.TLS_MIN_FLOWS)
            .select(F.unix_millis(F.col("w.start")).alias("window_start_ms"), "dst_ip", "flows"))


def sliding_port_scan(flows: DataFrame, window: str = "10 minutes", slide: str = "1 minute",
                      watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """The distinct counts of D14 per sliding window and source, by sketches.

    Every window goes out: its target count can still grow past the limit, and
    an update stream never takes back a row that a filter lets drop out. The
    rule is applied to the latest version of each window (``scan_windows``).
    """
    f = with_event_time(flows).withWatermark("event_time", watermark)
    return (f.where(F.col("src_ip").isNotNull())
            .groupBy(F.window("event_time", window, slide).alias("w"), "src_ip")
            .agg(F.approx_count_distinct("dst_port").alias("ports"),
                 F.approx_count_distinct("dst_ip").alias("targets"),
                 F.sum("bidirectional_packets").cast("bigint").alias("packets"))
            .select(F.unix_millis(F.col("w.start")).alias("window_start_ms"), "src_ip", "ports", "targets", "packets"))


_UNIT_MS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
#: Scan rows that a task combines at a time, and parts of the scan state.
SCAN_ROWS = 200_000
SCAN_PARTS = 512


def interval_ms(text: str) -> int:
    """Milliseconds of an interval like ``1 hour 30 minutes``."""
    found = re.findall(r"(\d+)\s+([a-z]+?)s?\b", text.lower())
    return sum(int(n) * _UNIT_MS[unit] for n, unit in found)


def _scan_rows(size: int, slide: int):
    """Flows to (src_ip, kind, value, first, last, packets, known): a row per port and one per target, with the
    windows that the flow lies in (``first`` to ``last``, as multiples of the slide). Equal rows are combined,
    so a pair that makes up much of the traffic reaches its task as few rows; packets go with the target."""
    keys = ["src_ip", "kind", "value", "first", "last"]

    def combined(frames: list[pd.DataFrame]) -> pd.DataFrame:
        f = pd.concat(frames)
        t = f["t"].to_numpy(np.int64)
        f = f.assign(first=(t - size) // slide + 1, last=t // slide)
        target = f.rename(columns={"dst_ip": "value"}).assign(kind="target")
        port = f[f["dst_port"].notna()].rename(columns={"dst_port": "value"}).assign(kind="port", packets=0, known=0)
        both = pd.concat([x[[*keys, "packets", "known"]] for x in (target, port)])
        return both.groupby(keys, dropna=False, sort=False, as_index=False).sum().replace({"value": {np.nan: None}})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for f in frames:
            held.append(f)
            n += len(f)
            if n >= SCAN_ROWS:
                yield combined(held)
                held, n = [], 0
        if n:
            yield combined(held)

    return run


def _covered(met: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of spans of windows sorted by (id, first): for each span its first window that no earlier span of its id
    holds, how many windows it adds, and whether it starts apart from them."""
    ids, first, last = (met[c].to_numpy(np.int64) for c in ("id", "first", "last"))
    if not len(ids):
        return first, first, first.astype(bool)
    wide = int(last.max() - first.min()) + 3
    reach = np.maximum.accumulate(ids * wide + (last - first.min()))  # the furthest window so far; an id starts above all before
    before = np.append(-2, reach[:-1]) - ids * wide + first.min()
    new_id = np.append(True, ids[1:] != ids[:-1])
    start = np.where(new_id, first, np.maximum(first, before + 1))
    return start, np.maximum(last - start + 1, 0), new_id | (first > before + 1)


def _spread(rows: pd.DataFrame, start: np.ndarray, n: np.ndarray, **values) -> pd.DataFrame:
    """(src_ip, window, values) summed: each row's values for its ``n`` windows from ``start`` on."""
    at = np.repeat(np.arange(len(rows)), n)
    window = start[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    out = pd.DataFrame({"src_ip": rows["src_ip"].to_numpy()[at], "window": window, **{k: np.asarray(v, np.int64)[at] for k, v in values.items()}})
    return out.groupby(["src_ip", "window"], sort=False, as_index=False).sum()


class ScanCounts(StatefulProcessor):
    """What each part adds to the (window, source) counts: ports and targets not met in that window before, and packets.

    A part holds the (source, port or target) pairs of one hash range, each with the spans of windows it was met in.
    Windows that the watermark has passed are closed: they leave the state and take no more rows.
    """

    MET = ["src_ip", "kind", "value", "first", "last"]

    def __init__(self, size: int, slide: int):
        self.size, self.slide = size, slide

    def init(self, handle) -> None:
        self.state = handle.getValueState("met", "rows binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        open_from = (timerValues.getCurrentWatermarkInMs() - self.size) // self.slide + 1
        met = pd.DataFrame(columns=self.MET)
        if self.state.exists():
            met = pa.ipc.open_stream(self.state.get()[0]).read_all().to_pandas()
            met = met[met["last"] >= open_from]
            met["first"] = met["first"].clip(lower=open_from)
        out, held, n = [], [], 0
        for f in rows:
            held.append(f)
            n += len(f)
            if n >= SCAN_ROWS:
                met = self.absorb(met, pd.concat(held), open_from, out)
                held, n = [], 0
        if n:
            met = self.absorb(met, pd.concat(held), open_from, out)
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(met[self.MET].astype({"first": "int64", "last": "int64"}), preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))
        if out:
            counts = ["ports", "targets", "packets", "known"]
            total = pd.concat(out).groupby(["src_ip", "window"], sort=False, as_index=False)[counts].sum()
            ends = total.pop("window").to_numpy(np.int64) * self.slide + self.size
            total["closes"] = pd.to_datetime(ends * 1000 - 1, unit="us", utc=True)  # inside the window, past a watermark before its end
            yield total[["closes", "src_ip", *counts]]

    def absorb(self, met: pd.DataFrame, rows: pd.DataFrame, open_from: int, out: list[pd.DataFrame]) -> pd.DataFrame:
        """Appends what ``rows`` add to ``out``; the state with them."""
        rows = rows[rows["last"] >= open_from]
        rows = rows.assign(first=rows["first"].clip(lower=open_from))
        first, n = rows["first"].to_numpy(np.int64), (rows["last"] - rows["first"] + 1).to_numpy(np.int64)
        flows = (rows["kind"] == "target").to_numpy()
        part = [_spread(rows[flows], first[flows], n[flows], packets=rows["packets"][flows], known=rows["known"][flows])]
        both = pd.concat([met.assign(sign=-1), rows.loc[rows["value"].notna(), self.MET].assign(sign=1)], ignore_index=True)
        both["id"] = both.groupby(["src_ip", "kind", "value"], sort=False).ngroup()
        both = both.sort_values(["id", "first"], kind="stable")
        start, more, apart = _covered(both)
        old = both[both["sign"] < 0]
        for these, start_, n_, sign in ((both, start, more, 1), (old, *_covered(old)[:2], -1)):
            port = (these["kind"] == "port").to_numpy()
            part.append(_spread(these, start_, n_, ports=sign * port, targets=sign * ~port))
        out.append(pd.concat(part).fillna(0).groupby(["src_ip", "window"], sort=False, as_index=False).sum()
                   .astype({c: "int64" for c in ("ports", "targets", "packets", "known")}))
        span = np.cumsum(apart)
        return both.assign(span=span).groupby("span", sort=False).agg(
            src_ip=("src_ip", "first"), kind=("kind", "first"), value=("value", "first"), first=("first", "min"), last=("last", "max"))


def exact_port_scan(flows: DataFrame, window: str = "10 minutes", slide: str = "1 minute",
                    watermark: str = DEFAULT_WATERMARK, parts: int = SCAN_PARTS) -> DataFrame:
    """Exact ports, targets and packets of D14 per closed sliding window and source (append mode).

    Two stateful steps. The first (``ScanCounts``) keeps, for each source and
    port or target, the spans of windows it was met in, and hands on what
    a micro-batch adds; a flow is shuffled twice, not once per window, and a
    pair that comes all the time is one span. Its keys are hash parts of these
    pairs, so a busy source is spread over all tasks. The second sums. Both
    drop a window once the watermark has passed its end. A window goes out
    then, once, and is final; the rule is ``scan_windows``.
    """
    size, step = interval_ms(window), interval_ms(slide)
    packets = F.col("bidirectional_packets").cast("bigint")
    f = with_event_time(flows.where(F.col("src_ip").isNotNull())).withWatermark("event_time", watermark)
    f = f.where(F.col("event_time").isNotNull()).select(
        "src_ip", F.col("dst_port").cast("string").alias("dst_port"), "dst_ip", F.unix_millis("event_time").alias("t"),
        F.coalesce(packets, F.lit(0).cast("bigint")).alias("packets"), packets.isNotNull().cast("bigint").alias("known"))
    rows = f.mapInPandas(_scan_rows(size, step), "src_ip string, kind string, value string, first bigint, last bigint, packets bigint, known bigint")
    spread = F.when(F.col("value").isNull(), F.col("first"))  # rows without a value need no state: anywhere
    rows = rows.withColumn("part", F.pmod(F.xxhash64("src_ip", "kind", "value", spread), F.lit(parts)).cast("int"))
    added = rows.groupBy("part").transformWithStateInPandas(
        ScanCounts(size, step), "closes timestamp, src_ip string, ports bigint, targets bigint, packets bigint, known bigint",
        "append", "EventTime", eventTimeColumnName="closes")
    closing = F.window("closes", f"{step} milliseconds", f"{step} milliseconds", f"{size % step} milliseconds")  # ends as the scan's window does
    total = added.groupBy(closing.alias("w"), "src_ip").agg(*[F.sum(c).alias(c) for c in ("ports", "targets", "packets", "known")])
    return total.select((F.unix_millis(F.col("w.end")) - size).alias("window_start_ms"), "src_ip", "ports", "targets",
                        F.when(F.col("known") > 0, F.col("packets")).alias("packets"))


def is_scan() -> Column:
    return (F.col("ports") > det.SCAN_MIN_PORTS) & (F.col("targets") < det.SCAN_MAX_TARGETS)


def scan_windows(latest: DataFrame) -> DataFrame:
    """The windows that are scans now."""
    return latest.where(is_scan())


def packet_sessions(packets: DataFrame, gap: str = "120 seconds", watermark: str = "1 hour") -> DataFrame:
    """T4: bidirectional sessions of packets (idle gap only) with ``session_window``."""
    from netsift.operators.metering import KEY, canonical
    p = canonical(packets).withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", watermark)
    return (p.groupBy(*KEY, F.session_window("event_time", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("packets"), F.sum("len").cast("bigint").alias("bytes"),
                 F.min("ts_ms").alias("first_seen_ms"), F.max("ts_ms").alias("last_seen_ms"))
            .select(*KEY, "packets", "bytes", "first_seen_ms", "last_seen_ms"))


HEARTBEAT_IP = "0.0.0.0"


def flush_sessions(spark: SparkSession, landing: str, max_ts_ms: int, gap_ms: int, watermark_ms: int) -> str:
    """Land one heartbeat packet (reserved endpoint ``0.0.0.0``) far enough
    after ``max_ts_ms`` that the watermark passes every real session's end, so
    a drained append-mode session stream emits its last sessions. A live
    stream gets the same effect from new traffic; the heartbeat key is dropped
    from the output."""
    from netsift.schema import PACKET_SCHEMA
    ts = max_ts_ms + 2 * (gap_ms + watermark_ms) + 1
    row = [(-1, HEARTBEAT_IP, HEARTBEAT_IP, 0, 0, 0, ts, 0)]
    spark.createDataFrame(row, PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    return landing


# --- sinks -------------------------------------------------------------------------------

def run_append(stream: DataFrame, path: str, checkpoint: str) -> str:
    """Drain an append-mode stream into Parquet (``availableNow``)."""
    use_rocksdb_state(stream.sparkSession)
    q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return path


def run_upsert(stream: DataFrame, path: str, checkpoint: str) -> str:
    """Drain an aggregating stream in update mode; each micro-batch's updated
    rows are appended with their ``batch_id`` (see ``read_latest``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    use_rocksdb_state(stream.sparkSession)
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    return path


def read_latest(spark: SparkSession, path: str, key: list[str], schema: str | None = None) -> DataFrame:
    """The last version of every key written by ``run_upsert``."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if schema is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # the stream has written nothing
    w = Window.partitionBy(*key).orderBy(F.desc("batch_id"))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "batch_id")


def static_join_each_batch(stream: DataFrame, load_static: Callable[[SparkSession], DataFrame],
                           fn: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str) -> str:
    """Per micro-batch, re-read the static side and apply ``fn(batch, static)``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = fn(batch, load_static(batch.sparkSession))
        out.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return path


def threat_domain_hits(batch: DataFrame, indicators: DataFrame) -> DataFrame:
    """T6 body: J1 matches of a micro-batch's DNS names against the indicators."""
    names = det.dns_flows(batch).where(F.col("requested_server_name").isNotNull()) \
        .select(F.col("requested_server_name").alias("domain")).distinct()
    ind = indicators.select(dom.normalize("value").alias("matched")).where(F.col("matched") != "").distinct()
    sfx = names.select("domain", F.explode(dom.suffixes(dom.normalize("domain"))).alias("matched"))
    return (sfx.join(ind, "matched").groupBy("domain")
            .agg(F.max_by("matched", F.length("matched")).alias("matched_threat_domain")))


# --- T4 with the active-timeout cap: stateful metering ------------------------------------

_ST_FIELDS = ["flow_start", "last_ts", "init_a", "n", "bytes", "ab_n", "ab_b", "ba_n", "ba_b", "first_ms",
              "sum_len", "sumsq_len", "n_piat", "sum_piat", "sumsq_piat"]
METER_STATE = ("flow_start long, last_ts long, init_a boolean, n long, bytes long, ab_n long, ab_b long, "
               "ba_n long, ba_b long, first_ms long, sum_len double, sumsq_len double, n_piat long, "
               "sum_piat double, sumsq_piat double")
METER_OUT = ("src_ip string, dst_ip string, src_port int, dst_port int, protocol int, bidirectional_packets long, "
             "src2dst_packets long, dst2src_packets long, bidirectional_bytes long, src2dst_bytes long, "
             "dst2src_bytes long, bidirectional_first_seen_ms long, bidirectional_last_seen_ms long, "
             "bidirectional_duration_ms double, bidirectional_mean_ps double, bidirectional_stddev_ps double, "
             "bidirectional_mean_piat_ms double, bidirectional_stddev_piat_ms double")


def _sd(n, s, ss):
    return float(np.sqrt(max(0.0, (ss - s * s / n) / (n - 1)))) if n > 1 else 0.0


def _emit(key, st: dict) -> dict:
    a_ip, a_port, b_ip, b_port, proto = key
    ia = bool(st["init_a"])
    return {"src_ip": a_ip if ia else b_ip, "dst_ip": b_ip if ia else a_ip,
            "src_port": a_port if ia else b_port, "dst_port": b_port if ia else a_port, "protocol": proto,
            "bidirectional_packets": st["n"], "src2dst_packets": st["ab_n"] if ia else st["ba_n"],
            "dst2src_packets": st["ba_n"] if ia else st["ab_n"], "bidirectional_bytes": st["bytes"],
            "src2dst_bytes": st["ab_b"] if ia else st["ba_b"], "dst2src_bytes": st["ba_b"] if ia else st["ab_b"],
            "bidirectional_first_seen_ms": st["first_ms"], "bidirectional_last_seen_ms": st["last_ts"],
            "bidirectional_duration_ms": float(st["last_ts"] - st["first_ms"]),
            "bidirectional_mean_ps": st["sum_len"] / st["n"],
            "bidirectional_stddev_ps": _sd(st["n"], st["sum_len"], st["sumsq_len"]),
            "bidirectional_mean_piat_ms": st["sum_piat"] / st["n_piat"] if st["n_piat"] else 0.0,
            "bidirectional_stddev_piat_ms": _sd(st["n_piat"], st["sum_piat"], st["sumsq_piat"])}


def _meter_fn(idle_ms: int, active_ms: int):
    import pandas as pd

    cols = [f.split()[0] for f in METER_OUT.split(", ")]

    def pieces(key, pdf, st):
        """(finished pieces, the open one) of packets in time order that follow the state ``st``, if any."""
        have = st is not None
        ts = pdf["ts_ms"].to_numpy(dtype=np.int64)
        ln = pdf["len"].to_numpy(dtype=float)
        ab = pdf["a_to_b"].to_numpy(dtype=bool)
        prev = np.empty_like(ts)
        prev[1:] = ts[:-1]
        prev[0] = st["last_ts"] if have else 0
        has_prev = np.ones(len(ts), dtype=bool)
        has_prev[0] = have
        is_start = ~has_prev | (ts - prev >= idle_ms)
        starts = pd.Series(np.where(is_start, ts, np.nan))
        if not is_start[0]:
            starts.iloc[0] = st["flow_start"]
        fstart = starts.ffill().to_numpy(dtype=np.int64)
        piece = np.floor((ts - fstart) / active_ms)
        prev_piece = np.floor((prev - fstart) / active_ms)
        cont_state = have and not is_start[0] and prev_piece[0] == piece[0]
        new_piece = is_start | (piece != prev_piece)
        new_piece[0] = not cont_state
        piat = np.where(~new_piece, ts - prev, np.nan)
        pid = np.cumsum(new_piece) - (0 if cont_state else 1)
        out = [_emit(key, st)] if have and not cont_state else []  # the stored piece ended
        groups = pd.DataFrame({"pid": pid, "ts": ts, "len": ln, "ab": ab, "piat": piat, "fs": fstart})
        last_pid = int(pid[-1])
        for p, g in groups.groupby("pid", sort=True):
            piats = g["piat"].dropna().to_numpy()
            cur = {"flow_start": int(g["fs"].iloc[0]), "last_ts": int(g["ts"].iloc[-1]),
                   "init_a": bool(g["ab"].iloc[0]), "n": len(g), "bytes": int(g["len"].sum()),
                   "ab_n": int(g["ab"].sum()), "ab_b": int(g.loc[g["ab"], "len"].sum()),
                   "ba_n": int((~g["ab"]).sum()), "ba_b": int(g.loc[~g["ab"], "len"].sum()),
                   "first_ms": int(g["ts"].iloc[0]), "sum_len": float(g["len"].sum()),
                   "sumsq_len": float((g["len"] ** 2).sum()), "n_piat": len(piats),
                   "sum_piat": float(piats.sum()), "sumsq_piat": float((piats ** 2).sum())}
            if p == 0 and cont_state:
                for k in ("n", "bytes", "ab_n", "ab_b", "ba_n", "ba_b", "sum_len", "sumsq_len", "n_piat",
                          "sum_piat", "sumsq_piat"):
                    cur[k] = st[k] + cur[k]
                cur.update(flow_start=st["flow_start"], init_a=st["init_a"], first_ms=st["first_ms"])
            if p != last_pid:
                out.append(_emit(key, cur))
        return out, cur

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            st = dict(zip(_ST_FIELDS, state.get))
            state.remove()
            yield pd.DataFrame([_emit(key, st)], columns=cols)
            return
        pdf = pd.concat(list(pdfs)).sort_values(["ts_ms", "packet_id"])
        st = dict(zip(_ST_FIELDS, state.get)) if state.exists else None
        out = []
        if st is not None:
            late = pdf["ts_ms"] < st["last_ts"]
            if late.any():  # they lie before the open piece's last packet: flows of their own, done at once
                done, last = pieces(key, pdf[late], None)
                out += [*done, _emit(key, last)]
                pdf = pdf[~late]
        if len(pdf):
            done, st = pieces(key, pdf, st)
            out += done
        state.update(tuple(st[f] for f in _ST_FIELDS))
        state.setTimeoutTimestamp(max(st["last_ts"] + idle_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=cols)

    return fn


def stateful_metering(packets: DataFrame, idle_ms: int, active_ms: int, watermark: str = "1 hour") -> DataFrame:
    """T4 with the active cap: the batch metering definition (S2) on a stream.

    ``applyInPandasWithState`` keeps the open flow piece per 5-tuple (counts,
    sums and squared sums, so deviations merge across micro-batches); each
    micro-batch's packets of a key are processed with vectorised numpy; a
    piece is emitted when the next one starts or, through an event-time
    timeout, when the watermark passes its idle deadline. Packets that arrive
    in a later micro-batch than newer packets of their key form flows of their
    own, emitted at once; the open piece stays as it is.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    from netsift.operators.metering import KEY, canonical
    p = (canonical(packets).withColumn("event_time", F.timestamp_millis("ts_ms"))
         .withWatermark("event_time", watermark)
         .select(*KEY, "packet_id", "ts_ms", "len", "a_to_b", "event_time"))
    return p.groupBy(*KEY).applyInPandasWithState(
        _meter_fn(idle_ms, active_ms), METER_OUT, METER_STATE, "append", GroupStateTimeout.EventTimeTimeout)
