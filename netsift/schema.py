"""Fixed schemas and enumerations shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Every flow column an operator reads. Flow tables are read with this schema;
# optional columns missing from a source are added as typed NULLs.
FLOW_SCHEMA = T.StructType([
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("application_name", T.StringType()),
    T.StructField("application_confidence", T.IntegerType()),
    T.StructField("requested_server_name", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("bidirectional_packets", T.LongType()),
    T.StructField("src2dst_packets", T.LongType()),
    T.StructField("dst2src_packets", T.LongType()),
    T.StructField("bidirectional_bytes", T.LongType()),
    T.StructField("src2dst_bytes", T.LongType()),
    T.StructField("dst2src_bytes", T.LongType()),
    T.StructField("bidirectional_first_seen_ms", T.LongType()),
    T.StructField("bidirectional_last_seen_ms", T.LongType()),
    T.StructField("bidirectional_duration_ms", T.DoubleType()),
    T.StructField("bidirectional_mean_ps", T.DoubleType()),
    T.StructField("bidirectional_stddev_ps", T.DoubleType()),
    T.StructField("bidirectional_mean_piat_ms", T.DoubleType()),
    T.StructField("bidirectional_stddev_piat_ms", T.DoubleType()),
])

FLOW_COLUMNS = [f.name for f in FLOW_SCHEMA.fields]

PACKET_SCHEMA = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("len", T.LongType()),
])

# One alert schema for every detector.
ALERT_SCHEMA = T.StructType([
    T.StructField("engine_name", T.StringType()),
    T.StructField("threat_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("ioc", T.ArrayType(T.StringType())),
    T.StructField("mitre_technique", T.StringType()),
    T.StructField("recommended_action", T.StringType()),
])

ALERT_COLUMNS = [f.name for f in ALERT_SCHEMA.fields]

# --- fixed values (must equal the reference's enumerations) -------------------
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

THREAT_TYPES = [
    "WATERING_HOLE", "PHISHING", "PHISHING_DOMAIN", "EXPLOITATION",
    "C2_BEACON", "C2_DATA_EXFIL", "DNS_TUNNEL", "ICMP_TUNNEL", "UNCOMMON_PORT",
    "UNKNOWN_TLS", "UNUSUAL_PORT",
    "PORT_SCAN", "NETWORK_SCAN",
    "DATA_EXFILTRATION", "DNS_EXFILTRATION", "HTTP_EXFILTRATION",
    "MALICIOUS_IP", "MALICIOUS_DOMAIN", "DGA_DOMAIN", "UNKNOWN_DOMAIN",
    "SUSPICIOUS_USER_AGENT", "HTTP_POST_ANOMALY", "LARGE_DATA_TRANSFER",
    "SUSPICIOUS_COMMUNICATION", "BEHAVIORAL_ANOMALY", "ML_ANOMALY",
    "ONE_WAY_EXFILTRATION",
]

INDICATOR_CATEGORIES = [
    "whitelist_domains", "whitelist_ips", "whitelist_ports", "threat_ips",
    "threat_domains", "threat_urls", "attack_signatures",
    "suspicious_user_agents", "phishing_keywords", "suspicious_tlds",
]

CACHE_LEVELS = ["whitelist", "safe", "malicious"]
# ------------------------------------------------------------------------------
