"""Ad-hoc flow queries: filter (P1, P2), summaries (A1-A8), top flows.

Physical shape: filter (pushed into the Parquet scan) → partial HashAggregate →
shuffle on the group key → final HashAggregate → TakeOrderedAndProject for
top-k. Nothing is collected; every result is a DataFrame.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.operators.alerts import ranked


def filter_flows(flows: DataFrame, src_ip: str | None = None, dst_ip: str | None = None,
                 dst_port: int | None = None, protocol: str | None = None,
                 min_bytes: int = 0, min_packets: int = 0) -> DataFrame:
    """AND of the given conditions. ``protocol`` compares application_name;
    the minimum filters apply only when > 0."""
    cond = F.lit(True)
    if src_ip:
        cond = cond & (F.col("src_ip") == src_ip)
    if dst_ip:
        cond = cond & (F.col("dst_ip") == dst_ip)
    if dst_port is not None:
        cond = cond & (F.col("dst_port") == int(dst_port))
    if protocol:
        cond = cond & (F.col("application_name") == protocol)
    if min_bytes > 0:
        cond = cond & (F.col("bidirectional_bytes") >= int(min_bytes))
    if min_packets > 0:
        cond = cond & (F.col("bidirectional_packets") >= int(min_packets))
    return flows.where(cond)


def application_subset(flows: DataFrame, apps: list[str]) -> DataFrame:
    """Flows whose application_name is one of ``apps``."""
    return flows.where(F.col("application_name").isin(*apps))


def distinct_names(flows: DataFrame, col: str = "requested_server_name") -> DataFrame:
    """Distinct non-null values of a column."""
    return flows.where(F.col(col).isNotNull()).select(col).distinct()


def distinct_values(df: DataFrame, col, name: str) -> DataFrame:
    """Distinct non-null values of ``col`` as column ``name``, tied to an
    aggregate *output*.

    Catalyst pushes filters on grouping keys below an aggregate, all the way
    to the scan. For costly per-value predicates (entropy, rule scores)
    that means one evaluation per input row instead of one per distinct
    value. Emitting the value as ``when(count > 0, key)`` makes every
    predicate on it reference the aggregate's count, so it stays above the
    shuffle and runs once per distinct value (the aggregate stays a
    HashAggregate: the buffer is a fixed-width count).
    """
    c = F.col(col) if isinstance(col, str) else col
    return (df.select(c.alias("_k")).where(F.col("_k").isNotNull())
            .groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
            .select(F.when(F.col("_n") > 0, F.col("_k")).alias(name)))


def distinct_count(c: str, exact: bool = True):
    """Exact distinct count (Expand + two-level aggregation) or an HLL++
    sketch (one pass, bounded memory; ``rsd`` 1%) for very large inputs."""
    return F.count_distinct(c) if exact else F.approx_count_distinct(c, 0.01)


def traffic_summary(flows: DataFrame, exact: bool = True) -> DataFrame:
    """A1 + A2: totals, distinct endpoints / protocols and the time range (one row)."""
    return flows.agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.coalesce(F.sum("bidirectional_packets"), F.lit(0)).cast("bigint").alias("total_packets"),
        F.coalesce(F.sum("bidirectional_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
        distinct_count("src_ip", exact).alias("unique_src_ips"),
        distinct_count("dst_ip", exact).alias("unique_dst_ips"),
        distinct_count("protocol", exact).alias("unique_protocols"),
        F.min("bidirectional_first_seen_ms").alias("start_ms"),
        F.max("bidirectional_last_seen_ms").alias("end_ms"),
        (F.max("bidirectional_last_seen_ms") - F.min("bidirectional_first_seen_ms")).alias("duration_ms"),
    )


def protocol_distribution(flows: DataFrame, top: int = 20) -> DataFrame:
    """A3: flow count per application name (NULL excluded), top ``top``."""
    return (flows.where(F.col("application_name").isNotNull())
            .groupBy("application_name").agg(F.count(F.lit(1)).alias("flow_count"))
            .orderBy(F.desc("flow_count"), F.asc("application_name")).limit(top))


def _top_by_bytes(flows: DataFrame, key: str, k: int, out: str = "total_bytes") -> DataFrame:
    top = (flows.where(F.col(key).isNotNull())
           .groupBy(key).agg(F.sum("bidirectional_bytes").cast("bigint").alias(out))
           .orderBy(F.desc(out), F.asc(key)).limit(k))
    return ranked(top, [F.desc(out), F.asc(key)])


def top_talkers(flows: DataFrame, k: int = 10) -> DataFrame:
    """A4: bytes per source IP, top ``k`` (ties broken by IP)."""
    return _top_by_bytes(flows, "src_ip", k)


def top_destinations(flows: DataFrame, k: int = 10) -> DataFrame:
    """A4: bytes per destination IP, top ``k``."""
    return _top_by_bytes(flows, "dst_ip", k)


def port_profile(flows: DataFrame, port: int, k: int = 5) -> dict[str, DataFrame]:
    """A5: traffic to one destination port: totals and top ``k`` sources."""
    if not isinstance(port, int) or not 0 <= port <= 65535:
        raise ValueError(f"invalid port {port!r}: must be 0-65535")
    f = filter_flows(flows, dst_port=port)
    summary = (f.agg(F.count(F.lit(1)).alias("total_flows"),
                     F.count_distinct("src_ip").alias("unique_sources"),
                     F.count_distinct("dst_ip").alias("unique_destinations"),
                     F.coalesce(F.sum("bidirectional_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
                     F.coalesce(F.sum("bidirectional_packets"), F.lit(0)).cast("bigint").alias("total_packets"))
               .where(F.col("total_flows") > 0))
    return {"summary": summary, "top_sources": _top_by_bytes(f, "src_ip", k)}


def ip_profile(flows: DataFrame, ip: str, k: int = 5) -> dict[str, DataFrame]:
    """One IP as source and as destination: counts, bytes, top ``k`` peers.

    One scan: the filter ``src = ip OR dst = ip`` reaches the Parquet reader,
    and the two roles are split with a conditional aggregate + ``stack``.
    """
    ipaddress.ip_address(ip)  # raises ValueError for an invalid address
    f = flows.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
    as_src, as_dst = F.col("src_ip") == ip, F.col("dst_ip") == ip
    wide = f.agg(
        F.count(F.when(as_src, 1)).alias("src_n"),
        F.coalesce(F.sum(F.when(as_src, F.col("bidirectional_bytes"))), F.lit(0)).cast("bigint").alias("src_b"),
        F.count(F.when(as_dst, 1)).alias("dst_n"),
        F.coalesce(F.sum(F.when(as_dst, F.col("bidirectional_bytes"))), F.lit(0)).cast("bigint").alias("dst_b"))
    summary = wide.selectExpr(
        "stack(2, 'as_source', src_n, src_b, 'as_destination', dst_n, dst_b) AS (role, flow_count, total_bytes)")
    peers = (f.select(F.explode(F.array(
                F.when(as_src, F.struct(F.lit("as_source").alias("role"), F.col("dst_ip").alias("peer_ip"),
                                        F.col("bidirectional_bytes").alias("b"))),
                F.when(as_dst, F.struct(F.lit("as_destination").alias("role"), F.col("src_ip").alias("peer_ip"),
                                        F.col("bidirectional_bytes").alias("b"))))).alias("x"))
             .where(F.col("x").isNotNull() & F.col("x.peer_ip").isNotNull())
             .groupBy("x.role", "x.peer_ip").agg(F.sum("x.b").cast("bigint").alias("total_bytes")))
    from netsift.operators.topk import top_k_per_group
    top = top_k_per_group(peers, ["role"], [F.desc("total_bytes"), F.asc("peer_ip")], k, rank_col="rank")
    return {"summary": summary, "top_peers": top}


def app_profile(flows: DataFrame, app: str, k: int = 10) -> dict[str, DataFrame]:
    """Flows of one application: count, bytes and top ``k`` talkers."""
    f = filter_flows(flows, protocol=app)
    summary = (f.agg(F.count(F.lit(1)).alias("total_flows"),
                     F.coalesce(F.sum("bidirectional_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"))
               .where(F.col("total_flows") > 0))
    return {"summary": summary, "top_talkers": _top_by_bytes(f, "src_ip", k)}


LARGE_FLOW_COLUMNS = ["src_ip", "dst_ip", "dst_port", "bidirectional_bytes", "bidirectional_packets"]


def large_flows(flows: DataFrame, min_bytes: int = 1_000_000, k: int = 20) -> dict[str, DataFrame]:
    """Number of flows with bytes >= ``min_bytes`` and the top ``k`` of them."""
    f = filter_flows(flows, min_bytes=min_bytes)
    order = [F.desc("bidirectional_bytes")] + [F.asc(c) for c in LARGE_FLOW_COLUMNS if c != "bidirectional_bytes"]
    return {"summary": f.agg(F.count(F.lit(1)).alias("flow_count")),
            "top_flows": f.select(*LARGE_FLOW_COLUMNS).orderBy(*order).limit(k)}


def top_flows(flows: DataFrame, n: int = 50, score_column: str = "anomaly_score") -> DataFrame:
    """The ``n`` flows with the largest score (packets when the score is absent).

    Ties are broken by the remaining flow columns so the result is deterministic.
    """
    col = score_column if score_column in flows.columns else "bidirectional_packets"
    rest = [c for c in ("bidirectional_bytes", "src_ip", "dst_ip", "src_port", "dst_port",
                        "bidirectional_first_seen_ms") if c in flows.columns and c != col]
    return flows.orderBy(F.desc_nulls_last(col), *[F.asc(c) for c in rest]).limit(n)


def explore(flows: DataFrame, n: int = 20, **filters) -> DataFrame:
    """Optional filters (combined with AND), then the top ``n`` by bytes."""
    return top_flows(filter_flows(flows, **filters), n=n, score_column="bidirectional_bytes")
