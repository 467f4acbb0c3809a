"""Bindings from the driver's test tables to the flow-analytics tables.

``/root/testdata`` holds TPC-H-like tables, not network captures. These
projections turn them into a flow table (from ``lineitem``), a packet table
(from ``events``), reputation snapshots (from ``customer`` / ``part``) and a
URL table (from ``pages``). The same expression text is used by the Spark
adapter (``selectExpr``, so Catalyst prunes unused columns and pushes filters
into the scan) and, with one dialect substitution, by the DuckDB oracle.

``{US:x}`` is epoch microseconds of a timestamp column: a zone-free
``timestampdiff`` in Spark and ``epoch_us`` in DuckDB.
"""

from __future__ import annotations

import re

# --- fixed values: projection expressions (FIXTURES.md, part B) ---------------
# B.1 working columns, from lineitem
LINEITEM_WORK = [
    ("s", "l_suppkey"),
    ("p", "l_partkey"),
    ("n", "l_linenumber"),
    ("q", "CAST(l_quantity AS BIGINT)"),
    ("ep", "CAST(FLOOR(l_extendedprice) AS BIGINT)"),
    ("d", "CAST(ROUND(l_discount*100) AS BIGINT)"),
    ("t", "CAST(ROUND(l_tax*100) AS BIGINT)"),
    ("ms", "CAST(FLOOR({US:l_shipdate}/1000) AS BIGINT)"),
    ("c", "l_partkey % 8"),
]
# B.2 byte columns, on B.1
LINEITEM_BYTES = [
    ("s2d", "CASE WHEN d=10 THEN ep*400 WHEN c IN (0,1) THEN q*12 ELSE ep*10 END"),
    ("d2s", "CASE WHEN t=8 THEN ep*600 WHEN c IN (0,1) THEN q*9 ELSE ep END"),
]
# B.3 flows, on B.1 + B.2
FLOW_EXPRS = [
    ("src_ip", "CASE WHEN s=7 THEN '10.66.6.6' WHEN s%5=0 THEN concat('172.16.0.',CAST(s%250 AS STRING)) WHEN s%11=3 THEN concat('203.0.113.',CAST(s%250 AS STRING)) ELSE concat('10.0.0.',CAST(s%250 AS STRING)) END"),
    ("dst_ip", "CASE WHEN s=7 THEN concat('192.168.66.',CAST(p%3 AS STRING)) WHEN c IN (0,1) THEN CASE WHEN p%3=0 THEN '8.8.8.8' ELSE concat('192.168.1.',CAST(p%5 AS STRING)) END WHEN p%4=0 THEN concat('52.10.1.',CAST(p%250 AS STRING)) WHEN p%4=1 THEN concat('192.168.2.',CAST(p%250 AS STRING)) ELSE concat('45.33.',CAST(p%3 AS STRING),'.',CAST(p%250 AS STRING)) END"),
    ("src_port", "CAST(40000+p%1000 AS INT)"),
    ("dst_port", "CAST(CASE WHEN s=7 THEN 1000+p WHEN c IN (0,1) THEN 53 WHEN c IN (2,3) THEN 443 WHEN c=4 THEN 80 WHEN c=5 THEN 0 WHEN c=6 THEN 20000+p%97 ELSE 22 END AS INT)"),
    ("protocol", "CAST(CASE WHEN c IN (0,1) THEN 17 WHEN c=5 THEN 1 ELSE 6 END AS INT)"),
    ("application_name", "CASE WHEN c IN (0,1) THEN 'DNS' WHEN c IN (2,3) THEN 'TLS' WHEN c=4 THEN 'HTTP' WHEN c=5 THEN 'ICMP' WHEN c=6 THEN 'Unknown' ELSE 'SSH' END"),
    ("application_confidence", "CAST(n*20 AS INT)"),
    ("requested_server_name", "CASE WHEN c=0 AND p%24=0 THEN concat(substr(md5(CAST(p AS STRING)),1,26),'.xyz') WHEN c IN (0,1,2,3) THEN concat('h',CAST(p%60 AS STRING),'.site',CAST(p%17 AS STRING),'.example.',CASE WHEN p%2=0 THEN 'org' ELSE 'net' END) END"),
    ("user_agent", "CASE WHEN c=4 THEN CASE n WHEN 1 THEN 'curl/8.0' WHEN 2 THEN 'Mozilla/5.0' WHEN 3 THEN 'python-requests/2.31 (Java/17)' END END"),
    ("bidirectional_packets", "q*2"),
    ("src2dst_packets", "q"),
    ("dst2src_packets", "q"),
    ("bidirectional_bytes", "s2d+d2s"),
    ("src2dst_bytes", "s2d"),
    ("dst2src_bytes", "d2s"),
    ("bidirectional_first_seen_ms", "ms"),
    ("bidirectional_last_seen_ms", "ms+n*q*137"),
    ("bidirectional_duration_ms", "CAST(n*q*137 AS DOUBLE)"),
    ("bidirectional_mean_ps", "CAST(s2d+d2s AS DOUBLE)/(q*2)"),
    ("bidirectional_stddev_ps", "CAST(t*7+d AS DOUBLE)"),
    ("bidirectional_mean_piat_ms", "CAST(n*q*137 AS DOUBLE)/(q*2)"),
    ("bidirectional_stddev_piat_ms", "CAST(n*11 AS DOUBLE)"),
]
# B.4 packets, from events
PACKET_EXPRS = [
    ("packet_id", "event_id"),
    ("src_ip", "concat('10.1.0.',CAST(user_id%250 AS STRING))"),
    ("dst_ip", "CASE WHEN event_type='error' THEN '45.33.0.1' ELSE '52.10.1.1' END"),
    ("src_port", "CAST(50000+user_id%1000 AS INT)"),
    ("dst_port", "CAST(443 AS INT)"),
    ("protocol", "CAST(6 AS INT)"),
    ("ts_ms", "CAST(FLOOR({US:ts}/1000) AS BIGINT)"),
    ("len", "CAST(ROUND(value*100) AS BIGINT)"),
]
# B.5 ip_reputation, from customer: every customer has an address of its own
IP_REPUTATION_EXPRS = [
    ("ip", "concat(CAST(45+CAST(FLOOR(c_custkey/150000) AS BIGINT) AS STRING),'.',"
           "CAST(33+CAST(FLOOR(c_custkey/750) AS BIGINT)%200 AS STRING),'.',CAST(c_custkey%3 AS STRING),'.',CAST(c_custkey%250 AS STRING))"),
    ("abuse_score", "CAST((c_custkey*7)%101 AS INT)"),
    ("isp", "CASE c_custkey%4 WHEN 0 THEN 'Google LLC' WHEN 1 THEN 'Fastly' ELSE c_mktsegment END"),
    ("age_days", "CAST(c_custkey%120 AS INT)"),
]
# B.6 domain_reputation, from part
DOMAIN_REPUTATION_EXPRS = [
    ("domain", "concat(substr(md5(CAST(p_partkey AS STRING)),1,26),'.xyz')"),
    ("severity", "CASE p_partkey%5 WHEN 0 THEN 'malicious' WHEN 1 THEN 'suspicious' ELSE 'info' END"),
    ("judgment", "CASE p_partkey%5 WHEN 2 THEN 'Whitelist' ELSE 'Other' END"),
    ("is_malicious", "p_partkey%5=0"),
]
# B.7 small literal tables
THREAT_DOMAINS = ["site3.example.org", "site5.example.net", "absent.invalid"]
THREAT_CIDRS = ["45.33.0.0/24", "203.0.113.0/24", "1.2.3.4/32"]
FEED_OPS = ["+a.example", "-site3.example.org", "plain.example"]
THREAT_URL_RULE = "page_id % 7 = 0"
# ------------------------------------------------------------------------------

_US = re.compile(r"\{US:(\w+)\}")


def render(expr: str, dialect: str) -> str:
    """Substitute the one engine-specific piece of the projection SQL."""
    if dialect == "spark":
        return _US.sub(
            r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))",
            expr)
    if dialect == "duckdb":
        return _US.sub(r"epoch_us(\1)", expr)
    raise ValueError(dialect)


def select_list(exprs, dialect: str) -> list[str]:
    return [f"{render(e, dialect)} AS {name}" for name, e in exprs]


def flows_sql(dialect: str = "duckdb", source: str = "lineitem") -> str:
    """The flow projection as one SQL query (used as a CTE by the oracle)."""
    w = ", ".join(select_list(LINEITEM_WORK, dialect))
    b = ", ".join(select_list(LINEITEM_BYTES, dialect))
    f = ", ".join(select_list(FLOW_EXPRS, dialect))
    return (f"SELECT {f} FROM (SELECT *, {b} FROM (SELECT {w} FROM {source}) w1) w2")


def packets_sql(dialect: str = "duckdb") -> str:
    return f"SELECT {', '.join(select_list(PACKET_EXPRS, dialect))} FROM events"


def ip_reputation_sql(dialect: str = "duckdb") -> str:
    return (f"SELECT {', '.join(select_list(IP_REPUTATION_EXPRS, dialect))} "
            "FROM customer")


def domain_reputation_sql(dialect: str = "duckdb") -> str:
    return (f"SELECT {', '.join(select_list(DOMAIN_REPUTATION_EXPRS, dialect))} "
            "FROM part")


def values_sql(values: list[str], col: str) -> str:
    rows = ", ".join("('" + v.replace("'", "''") + "')" for v in values)
    return f"SELECT * FROM (VALUES {rows}) AS v({col})"
