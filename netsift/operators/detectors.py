"""Rule detectors.

Each detector is two functions: ``<name>(flows, ...)`` returns the flat,
typed findings (one row per alert; what the SQL oracle checks) and
``<name>_alerts(flows, ...)`` projects them onto ALERT_SCHEMA.

Per-flow detectors are single narrow filters. Grouped detectors aggregate with
partial (map-side) aggregation before the shuffle, so a hot key (one resolver
or one scanner holding a third of all flows) becomes one pre-aggregated row
per task instead of a hot partition. Per-name samples (first source IPs,
sample ports) use the salted two-level top-k of ``topk.py``, so no unbounded
list is collected and no hot name lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions import domain as dom
from netsift.functions import ip as ipf
from netsift.operators.alerts import to_alerts
from netsift.operators.flows import distinct_values
from netsift.operators.topk import top_k_per_group

# --- fixed values -------------------------------------------------------------
DNS_TUNNEL_PACKETS = 20           # D3: packets per resolver over DNS flows
DGA_ENTROPY = 3.5                 # D4: entropy of the second-level label
DGA_MIN_LENGTH = 10               # D4: label longer than this
HTTP_APPS = ["HTTP", "HTTPS", "TLS"]
HTTP_RATIO = 10                   # D5: response / request
HTTP_MIN_RESPONSE = 1_000_000     # D5
COMMON_PORTS = [20, 21, 22, 23, 25, 53, 67, 68, 80, 88, 110, 123, 137, 138, 139, 143,
                389, 443, 445, 465, 514, 587, 636, 993, 995, 1433, 3306, 3389, 5432,
                8080, 8443, 3000, 5000, 8000, 9090]
UNCOMMON_PORT_FLOWS = 10          # D6: flows per port greater than this
SUSPICIOUS_UA = ["python-requests", "curl", "wget", "powershell", "go-http-client",
                 "java/", "nikto", "sqlmap", "nmap"]
ICMP_MIN_BYTES = 1000             # D8
DNS_EXFIL_BYTES = 500             # D9
TLS_CONFIDENCE = 50               # D10: confidence below this is "unknown"
TLS_MIN_FLOWS = 5                 # D10: at least this many flows per destination
ONE_WAY_RATIO = 10                # D11
ONE_WAY_MIN_BYTES = 1_000_000     # D11
LARGE_TRANSFER_BYTES = 10 * 1024 * 1024   # D12
SUSPICIOUS_COMM_PACKETS = 50      # D13
SCAN_MIN_PORTS = 50               # D14: distinct ports greater than this
SCAN_MAX_TARGETS = 5              # D14: distinct targets fewer than this
PLUGIN_SCAN_THRESHOLD = 10        # D15 default (the documented sample uses 15)
PLUGIN_SCAN_SAMPLE = 20           # D15: sample ports in the evidence
SOURCE_IP_SAMPLE = 10             # A9: source IPs kept per domain
ML_DOMAIN_THRESHOLD = 0.85        # D2
ML_HIGH_SEVERITY = 0.95           # D2

DNS_ENGINE = "dns_threat_detector"
HTTP_ENGINE = "http_threat_detector"
COVERT_ENGINE = "covert_channel_detector"
BEHAVIOR_ENGINE = "behavioral_anomaly_detector"
PLUGIN_SCAN_ENGINE = "port_scan_detector"
# ------------------------------------------------------------------------------


def dns_flows(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("application_name") == "DNS")


def suppress_safe(names: DataFrame, safe_domains: DataFrame | None, col: str = "domain") -> DataFrame:
    """Optional suppression of names under a safe domain (exact, or lower-cased
    equal / '.'-suffix match). The reference stores the safe list in the DNS
    detector but never applies it, so detectors take it only when asked."""
    if safe_domains is None:
        return names
    from netsift.operators.indicators import safe_domain_lookup
    return safe_domain_lookup(names, col, safe_domains, anti=True)


# --- A9: per-domain statistics -------------------------------------------------

def domain_query_stats(dns: DataFrame, domains: DataFrame, key: Column | None = None,
                       k: int = SOURCE_IP_SAMPLE) -> DataFrame:
    """For each name in ``domains(domain)``: flow count and the first ``k``
    distinct source IPs (in IP order, comma-joined).

    ``key`` maps a flow to the name it is counted under (raw name by default,
    normalised name for D17). Flows are combined by (name, source) on the map
    side first, so a hot name enters the join with its sources, not its flows;
    count and sample both come from that one aggregate (Spark reuses its
    exchange). An inner join on distinct names: a semi join would be pushed
    below the aggregate, back to the flows.
    """
    key = key if key is not None else F.col("requested_server_name")
    base = (dns.select(key.alias("domain"), "src_ip").where(F.col("domain").isNotNull())
            .groupBy("domain", "src_ip").agg(F.count(F.lit(1)).alias("n"))
            .join(domains.select("domain").distinct(), "domain"))
    counts = base.groupBy("domain").agg(F.sum("n").alias("query_count"))
    pairs = base.where(F.col("src_ip").isNotNull()).select("domain", "src_ip")
    sample = (top_k_per_group(pairs, ["domain"], [F.col("src_ip")], k)
              .groupBy("domain")
              .agg(F.array_join(F.array_sort(F.collect_list("src_ip")), ",").alias("source_ips")))
    return counts.join(sample, "domain", "left").select(
        "domain", "query_count", F.coalesce("source_ips", F.lit("")).alias("source_ips"))


# --- D1: threat-domain suffix match (J1 + A9) ----------------------------------

def match_domain_suffix(names: DataFrame, indicators: DataFrame, name_col: str = "domain",
                        value_col: str = "value") -> DataFrame:
    """Names that equal an indicator or end with '.' + indicator.

    Both sides are normalised (lower, trailing dots stripped). Each name is
    exploded into its label suffixes and equi-joined with the indicator set;
    the longest (most specific) matching indicator wins.
    """
    ind = indicators.select(dom.normalize(value_col).alias("matched")).where(F.col("matched") != "").distinct()
    sfx = names.select(F.col(name_col), F.explode(dom.suffixes(dom.normalize(name_col))).alias("matched"))
    hit = sfx.join(ind, "matched")
    return hit.groupBy(name_col).agg(F.max_by("matched", F.length("matched")).alias("matched"))


def threat_domains(flows: DataFrame, indicators: DataFrame, safe_domains: DataFrame | None = None) -> DataFrame:
    """D1 findings: domain, matched_threat_domain, query_count, source_ips."""
    dns = dns_flows(flows)
    names = suppress_safe(dns.where(F.col("requested_server_name").isNotNull())
                          .select(F.col("requested_server_name").alias("domain")).distinct(), safe_domains)
    matched = match_domain_suffix(names, indicators).withColumnRenamed("matched", "matched_threat_domain")
    stats = domain_query_stats(dns, matched)
    return matched.join(stats, "domain").select("domain", "matched_threat_domain", "query_count", "source_ips")


def threat_domains_alerts(flows: DataFrame, indicators: DataFrame,
                          safe_domains: DataFrame | None = None) -> DataFrame:
    f = threat_domains(flows, indicators, safe_domains)
    return to_alerts(
        f, engine=DNS_ENGINE, threat_type="PHISHING", severity="HIGH", confidence=0.9,
        description=F.format_string("Access to threat domain %s (matches %s)", "domain", "matched_threat_domain"),
        evidence={"domain": F.col("domain"), "matched_threat_domain": F.col("matched_threat_domain"),
                  "query_count": F.col("query_count"), "source_ips": F.col("source_ips")},
        ioc=[F.col("domain"), F.col("matched_threat_domain")],
        action="Isolate the hosts that resolved this domain")


# --- D2: unknown domains (model or rule branch) --------------------------------

def unknown_domain_names(flows: DataFrame, scores: DataFrame | None = None,
                         threshold: float = ML_DOMAIN_THRESHOLD, safe_domains: DataFrame | None = None) -> DataFrame:
    """D2 flagged set ``(domain, ml_score)`` without per-name statistics.

    With ``scores(domain, probability)`` from a trained model (M10) a name is
    flagged at probability >= threshold. Without a model the rule check (M7)
    decides and the score is 0.0, as in the reference.
    """
    names = suppress_safe(distinct_values(dns_flows(flows), "requested_server_name", "domain"), safe_domains)
    if scores is None:
        return names.where(dom.rule_suspicious("domain")).select("domain", F.lit(0.0).alias("ml_score"))
    return (names.join(scores.select("domain", F.col("probability").alias("ml_score")), "domain")
            .where(F.col("ml_score") >= threshold))


def unknown_domains(flows: DataFrame, scores: DataFrame | None = None,
                    threshold: float = ML_DOMAIN_THRESHOLD, safe_domains: DataFrame | None = None) -> DataFrame:
    """D2 findings: domain, ml_score, severity, query_count, source_ips."""
    flagged = unknown_domain_names(flows, scores, threshold, safe_domains)
    stats = domain_query_stats(dns_flows(flows), flagged)
    return (flagged.join(stats, "domain")
            .select("domain", "ml_score",
                    F.when(F.col("ml_score") > ML_HIGH_SEVERITY, "HIGH").otherwise("MEDIUM").alias("severity"),
                    "query_count", "source_ips"))


def unknown_domains_alerts(flows: DataFrame, scores: DataFrame | None = None,
                           safe_domains: DataFrame | None = None) -> DataFrame:
    f = unknown_domains(flows, scores, safe_domains=safe_domains)
    return to_alerts(
        f, engine=DNS_ENGINE, threat_type="UNKNOWN_DOMAIN", severity=F.col("severity"),
        confidence=F.col("ml_score"),
        description=F.format_string("Suspicious domain %s (score %.2f)", F.col("domain"), F.col("ml_score")),
        evidence={"domain": F.col("domain"), "ml_score": F.col("ml_score"),
                  "query_count": F.col("query_count"), "source_ips": F.col("source_ips")},
        ioc=[F.col("domain")], action="Investigate this domain further")


# --- D3: DNS tunnel ------------------------------------------------------------

def dns_tunnel(flows: DataFrame, threshold: int = DNS_TUNNEL_PACKETS) -> DataFrame:
    """D3 findings: dst_ip, packet_count (DNS packets per resolver > threshold)."""
    return (dns_flows(flows).where(F.col("dst_ip").isNotNull())
            .groupBy("dst_ip").agg(F.sum("bidirectional_packets").cast("bigint").alias("packet_count"))
            .where(F.col("packet_count") > threshold))


def dns_tunnel_alerts(flows: DataFrame, threshold: int = DNS_TUNNEL_PACKETS) -> DataFrame:
    f = dns_tunnel(flows, threshold)
    return to_alerts(
        f, engine=DNS_ENGINE, threat_type="DNS_TUNNEL", severity="HIGH", confidence=0.75,
        description=F.format_string("Possible DNS tunnel via %s (%d packets)", F.col("dst_ip"), F.col("packet_count")),
        evidence={"dst_ip": F.col("dst_ip"), "packet_count": F.col("packet_count")},
        ioc=[F.col("dst_ip")], mitre="T1071.004",
        action="Check DNS payload sizes and query patterns")


# --- D4: DGA domains -----------------------------------------------------------

def dga_domains(flows: DataFrame, min_length: int = DGA_MIN_LENGTH,
                threshold: float = DGA_ENTROPY, safe_domains: DataFrame | None = None) -> DataFrame:
    """D4 findings: domain, entropy. The label is taken from the raw-case name."""
    names = suppress_safe(distinct_values(dns_flows(flows), "requested_server_name", "domain"), safe_domains)
    sld = dom.sld_strict("domain")
    return (names.select("domain", sld.alias("sld"))
            .where(F.length("sld") > min_length)
            .select("domain", dom.entropy("sld").alias("entropy"))
            .where(F.col("entropy") > threshold))


def dga_domains_alerts(flows: DataFrame, safe_domains: DataFrame | None = None) -> DataFrame:
    f = dga_domains(flows, safe_domains=safe_domains)
    return to_alerts(
        f, engine=DNS_ENGINE, threat_type="DGA_DOMAIN", severity="HIGH", confidence=0.8,
        description=F.format_string("Possible generated domain %s (entropy %.2f)", F.col("domain"), F.col("entropy")),
        evidence={"domain": F.col("domain"), "entropy": F.col("entropy")},
        ioc=[F.col("domain")], mitre="T1583.001", action="Domain likely produced by malware")


# --- D5: HTTP response asymmetry -----------------------------------------------

def http_exfiltration(flows: DataFrame) -> DataFrame:
    """D5 findings: src_ip, dst_ip, src2dst_bytes, dst2src_bytes, ratio."""
    s, d = F.col("src2dst_bytes"), F.col("dst2src_bytes")
    return (flows.where(F.col("application_name").isin(*HTTP_APPS) & (s > 0) & (d > s * HTTP_RATIO)
                        & (d > HTTP_MIN_RESPONSE))
            .select("src_ip", "dst_ip", "src2dst_bytes", "dst2src_bytes", (d / s).alias("ratio")))


def http_exfiltration_alerts(flows: DataFrame) -> DataFrame:
    f = http_exfiltration(flows)
    return to_alerts(
        f, engine=HTTP_ENGINE, threat_type="HTTP_EXFILTRATION", severity="MEDIUM", confidence=0.5,
        description=F.format_string("HTTP response is %.1f times the request", F.col("ratio")),
        evidence={"src_ip": F.col("src_ip"), "dst_ip": F.col("dst_ip"), "ratio": F.col("ratio")},
        ioc=[F.col("dst_ip")], action="Check for unexpected downloads")


# --- D6: uncommon ports --------------------------------------------------------

def uncommon_ports(flows: DataFrame, min_flows: int = UNCOMMON_PORT_FLOWS) -> DataFrame:
    """D6 findings: port, count (flows to a non-standard port > min_flows)."""
    return (flows.where(F.col("dst_port").isNotNull() & ~F.col("dst_port").isin(*COMMON_PORTS))
            .groupBy(F.col("dst_port").alias("port")).agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") > min_flows))


def uncommon_ports_alerts(flows: DataFrame) -> DataFrame:
    f = uncommon_ports(flows)
    return to_alerts(
        f, engine=HTTP_ENGINE, threat_type="UNCOMMON_PORT", severity="MEDIUM", confidence=0.6,
        description=F.format_string("Traffic on uncommon port %d (%d flows)", F.col("port"), F.col("count")),
        evidence={"port": F.col("port"), "count": F.col("count")}, ioc=[],
        action="Verify the service running on this port")


# --- D7: suspicious user agents (P11) ------------------------------------------

def ua_hits(ua: Column, patterns: list[str] = SUSPICIOUS_UA) -> Column:
    """The patterns contained in the lower-cased user agent, in list order
    (concat of one-element arrays: code-generated, no higher-order function)."""
    low = F.lower(ua)
    empty = F.array().cast("array<string>")
    return F.concat(*[F.when(F.instr(low, p) > 0, F.array(F.lit(p))).otherwise(empty) for p in patterns])


def suspicious_user_agents(flows: DataFrame, patterns: list[str] = SUSPICIOUS_UA) -> DataFrame:
    """D7 findings: one row per flow whose agent contains a pattern."""
    return (flows.where(F.col("user_agent").isNotNull())
            .select("src_ip", "dst_ip", "user_agent", ua_hits(F.col("user_agent"), patterns).alias("hits"))
            .where(F.size("hits") > 0)
            .select("src_ip", "dst_ip", "user_agent", F.array_join("hits", ",").alias("hits")))


def suspicious_user_agents_alerts(flows: DataFrame) -> DataFrame:
    f = suspicious_user_agents(flows)
    return to_alerts(
        f, engine=HTTP_ENGINE, threat_type="SUSPICIOUS_USER_AGENT", severity="MEDIUM", confidence=0.65,
        description=F.concat(F.lit("Suspicious user agent: "), F.substring("user_agent", 1, 50)),
        evidence={"ua": F.col("user_agent"), "hits": F.col("hits")}, ioc=[],
        action="Agent commonly used by automated tools")


# --- D8, D9: covert channels ---------------------------------------------------

def icmp_tunnel(flows: DataFrame, min_bytes: int = ICMP_MIN_BYTES) -> DataFrame:
    """D8 findings: src_ip, dst_ip, bytes of ICMP flows above ``min_bytes``."""
    return (flows.where((F.col("protocol") == 1) & (F.col("bidirectional_bytes") > min_bytes))
            .select("src_ip", "dst_ip", F.col("bidirectional_bytes").alias("bytes")))


def icmp_tunnel_alerts(flows: DataFrame) -> DataFrame:
    f = icmp_tunnel(flows)
    return to_alerts(
        f, engine=COVERT_ENGINE, threat_type="ICMP_TUNNEL", severity="HIGH", confidence=0.7,
        description=F.format_string("Large ICMP flow: %d bytes (%s -> %s)", F.col("bytes"), F.col("src_ip"), F.col("dst_ip")),
        evidence={"bytes": F.col("bytes"), "src": F.col("src_ip"), "dst": F.col("dst_ip")},
        ioc=[F.col("dst_ip")], action="Ping packets are small; large ICMP volume suggests tunnelling")


def dns_exfiltration(flows: DataFrame, min_bytes: int = DNS_EXFIL_BYTES) -> DataFrame:
    """D9 findings: dst_ip, bytes of DNS flows above ``min_bytes``."""
    return (dns_flows(flows).where(F.col("bidirectional_bytes") > min_bytes)
            .select("dst_ip", F.col("bidirectional_bytes").alias("bytes")))


def dns_exfiltration_alerts(flows: DataFrame) -> DataFrame:
    f = dns_exfiltration(flows)
    return to_alerts(
        f, engine=COVERT_ENGINE, threat_type="DNS_EXFILTRATION", severity="HIGH", confidence=0.65,
        description=F.format_string("Large DNS flow: %d bytes", F.col("bytes")),
        evidence={"bytes": F.col("bytes"), "dst": F.col("dst_ip")},
        ioc=[F.col("dst_ip")], action="DNS queries are small; large volume may be exfiltration")


# --- D10: unidentified TLS -----------------------------------------------------

def unknown_tls(flows: DataFrame, require_confidence: bool = True) -> DataFrame:
    """D10 findings: dst_ip, flows (low-confidence TLS flows per destination).

    ``require_confidence=False`` is for sources without the confidence column:
    every TLS flow counts, as in the reference.
    """
    tls = flows.where(F.col("application_name") == "TLS")
    if require_confidence:
        tls = tls.where(F.col("application_confidence") < TLS_CONFIDENCE)
    return (tls.where(F.col("dst_ip").isNotNull()).groupBy("dst_ip")
            .agg(F.count(F.lit(1)).alias("flows")).where(F.col("flows") >= TLS_MIN_FLOWS))


def unknown_tls_alerts(flows: DataFrame, require_confidence: bool = True) -> DataFrame:
    f = unknown_tls(flows, require_confidence)
    return to_alerts(
        f, engine=COVERT_ENGINE, threat_type="UNKNOWN_TLS", severity="MEDIUM", confidence=0.5,
        description=F.format_string("Unidentified TLS traffic: %d flows to %s", F.col("flows"), F.col("dst_ip")),
        evidence={"dst": F.col("dst_ip"), "flows": F.col("flows")},
        ioc=[F.col("dst_ip")], action="Unidentified application over TLS; possible encrypted tunnel")


# --- D11: one-way transfer -----------------------------------------------------

def one_way_transfer(flows: DataFrame) -> DataFrame:
    """D11 findings: dst_ip, bytes (src→dst bytes > 10× the reverse and > 1 MB)."""
    s, d = F.col("src2dst_bytes"), F.col("dst2src_bytes")
    return (flows.where((s > d * ONE_WAY_RATIO) & (s > ONE_WAY_MIN_BYTES))
            .select("dst_ip", s.alias("bytes")))


def one_way_transfer_alerts(flows: DataFrame) -> DataFrame:
    f = one_way_transfer(flows)
    return to_alerts(
        f, engine=COVERT_ENGINE, threat_type="C2_DATA_EXFIL", severity="HIGH", confidence=0.7,
        description=F.format_string("One-way transfer: %.2f MB to %s", F.col("bytes") / 1e6, F.col("dst_ip")),
        evidence={"dst": F.col("dst_ip"), "bytes": F.col("bytes")},
        ioc=[F.col("dst_ip")], action="Strongly asymmetric traffic is typical of exfiltration")


# --- D12, D13, D14: behaviour --------------------------------------------------

def large_transfers(flows: DataFrame, min_bytes: int = LARGE_TRANSFER_BYTES) -> DataFrame:
    """D12 findings: src_ip, dst_ip, bytes (> 10 MiB)."""
    return (flows.where(F.col("bidirectional_bytes") > min_bytes)
            .select("src_ip", "dst_ip", F.col("bidirectional_bytes").alias("bytes")))


def large_transfers_alerts(flows: DataFrame) -> DataFrame:
    f = large_transfers(flows)
    return to_alerts(
        f, engine=BEHAVIOR_ENGINE, threat_type="LARGE_DATA_TRANSFER", severity="MEDIUM", confidence=0.5,
        description=F.format_string("Large transfer: %.2f MB", F.col("bytes") / 1e6),
        evidence={"bytes": F.col("bytes"), "src": F.col("src_ip"), "dst": F.col("dst_ip")},
        ioc=[F.col("dst_ip")], action="Confirm the transfer is expected")


def suspicious_communication(flows: DataFrame, min_packets: int = SUSPICIOUS_COMM_PACKETS) -> DataFrame:
    """D13 findings: internal source → unknown external destination, > 50 packets."""
    return (flows.where(ipf.is_private_pattern("src_ip") & ~ipf.is_private_pattern("dst_ip")
                        & ~ipf.has_safe_prefix("dst_ip") & (F.col("bidirectional_packets") > min_packets))
            .select("src_ip", "dst_ip", F.col("bidirectional_packets").alias("packets")))


def suspicious_communication_alerts(flows: DataFrame) -> DataFrame:
    f = suspicious_communication(flows)
    return to_alerts(
        f, engine=BEHAVIOR_ENGINE, threat_type="SUSPICIOUS_COMMUNICATION", severity="MEDIUM", confidence=0.55,
        description=F.format_string("Internal %s sent %d packets to unknown external %s",
                                    F.col("src_ip"), F.col("packets"), F.col("dst_ip")),
        evidence={"src": F.col("src_ip"), "dst": F.col("dst_ip"), "packets": F.col("packets")},
        ioc=[F.col("dst_ip")], action="Check the internal host for a C2 implant")


def port_scan(flows: DataFrame, min_ports: int = SCAN_MIN_PORTS, max_targets: int = SCAN_MAX_TARGETS) -> DataFrame:
    """D14 findings: src_ip, ports, targets, packets.

    Two exact distinct counts in one aggregate: Catalyst rewrites them into an
    Expand + two-level aggregation keyed by (src, value), so a source with a
    third of all flows is still spread over many tasks before the final count.
    """
    return (flows.where(F.col("src_ip").isNotNull()).groupBy("src_ip")
            .agg(F.count_distinct("dst_port").alias("ports"),
                 F.count_distinct("dst_ip").alias("targets"),
                 F.coalesce(F.sum("bidirectional_packets"), F.lit(0)).cast("bigint").alias("packets"))
            .where((F.col("ports") > min_ports) & (F.col("targets") < max_targets)))


def port_scan_alerts(flows: DataFrame) -> DataFrame:
    f = port_scan(flows)
    return to_alerts(
        f, engine=BEHAVIOR_ENGINE, threat_type="PORT_SCAN", severity="HIGH", confidence=0.8,
        description=F.format_string("Port scan: %s probed %d ports on %d targets",
                                    F.col("src_ip"), F.col("ports"), F.col("targets")),
        evidence={"src": F.col("src_ip"), "ports": F.col("ports"), "targets": F.col("targets")},
        ioc=[F.col("src_ip")], mitre="T1046", action="Typical reconnaissance; consider blocking the source")


# --- D15: the documented user detector -----------------------------------------

def plugin_port_scan(flows: DataFrame, threshold: int = PLUGIN_SCAN_THRESHOLD,
                     sample: int = PLUGIN_SCAN_SAMPLE) -> DataFrame:
    """D15 findings: src_ip, port_count, sample_ports, confidence.

    Distinct non-zero ports per non-empty source >= threshold. The sample is
    the ``sample`` smallest ports, taken with a partial WindowGroupLimit, so
    no per-source port list is materialised.
    """
    pairs = (flows.where(F.col("src_ip").isNotNull() & (F.col("src_ip") != "")
                         & F.col("dst_port").isNotNull() & (F.col("dst_port") != 0))
             .select("src_ip", "dst_port").distinct())
    counts = pairs.groupBy("src_ip").agg(F.count(F.lit(1)).alias("port_count")) \
        .where(F.col("port_count") >= threshold)
    samples = (top_k_per_group(pairs.join(counts.select("src_ip"), "src_ip", "left_semi"), ["src_ip"],
                               [F.col("dst_port")], sample)
               .groupBy("src_ip")
               .agg(F.array_join(F.array_sort(F.collect_list("dst_port")), ",").alias("sample_ports")))
    return (counts.join(samples, "src_ip")
            .select("src_ip", "port_count", "sample_ports",
                    F.least(F.lit(1.0), F.col("port_count") / (2.0 * threshold)).alias("confidence")))


def plugin_port_scan_alerts(flows: DataFrame, threshold: int = PLUGIN_SCAN_THRESHOLD) -> DataFrame:
    f = plugin_port_scan(flows, threshold)
    return to_alerts(
        f, engine=PLUGIN_SCAN_ENGINE, threat_type="PORT_SCAN", severity="MEDIUM", confidence=F.col("confidence"),
        description=F.format_string("Port scan: %s probed %d ports", F.col("src_ip"), F.col("port_count")),
        evidence={"source_ip": F.col("src_ip"), "port_count": F.col("port_count"),
                  "sample_ports": F.col("sample_ports")},
        ioc=[F.col("src_ip")], mitre="T1046", action="Review other activity of this source")
