"""Independent DuckDB SQL for the registered queries (the correctness oracle).

Each query inlines the test-table projection as a CTE and restates the
operator in plain SQL. Integer outputs are BIGINT/INT on both sides and
doubles are rounded to 6 places so value hashes compare exactly.
"""

from __future__ import annotations

from netsift.functions import domain as dom
from netsift.functions import ip as ipf
from netsift.operators import detectors as det
from netsift.sources import fixtures as fx


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def with_flows(body: str, extra: str = "") -> str:
    ctes = f"flows AS ({fx.flows_sql('duckdb')})"
    if extra:
        ctes += ", " + extra
    return f"WITH {ctes} {body}"


def entropy_cte(name: str, src: str, key: str, text: str) -> str:
    """CTE ``name(key, entropy)``: Shannon entropy of ``text`` per ``key``."""
    return (f"{name}_c AS (SELECT {key} AS k, {text} AS t, unnest(string_split({text}, '')) AS ch FROM {src} "
            f"WHERE length({text}) > 0), "
            f"{name}_f AS (SELECT k, t, ch, count(*) AS n FROM {name}_c GROUP BY k, t, ch), "
            f"{name} AS (SELECT k AS {key}, -sum((n / length(t)) * log2(n / length(t))) AS entropy "
            f"FROM {name}_f GROUP BY k)")


def domain_stats_cte(name: str, dns: str, domains: str, key: str = "requested_server_name",
                     k: int = det.SOURCE_IP_SAMPLE) -> str:
    """CTE ``name(domain, query_count, source_ips)``."""
    return (f"{name}_b AS (SELECT {key} AS domain, src_ip FROM {dns} WHERE {key} IS NOT NULL "
            f"AND {key} IN (SELECT domain FROM {domains})), "
            f"{name}_n AS (SELECT domain, count(*) AS query_count FROM {name}_b GROUP BY domain), "
            f"{name}_i AS (SELECT domain, string_agg(src_ip, ',' ORDER BY src_ip) AS source_ips FROM ("
            f"SELECT domain, src_ip, row_number() OVER (PARTITION BY domain ORDER BY src_ip) AS rn FROM ("
            f"SELECT DISTINCT domain, src_ip FROM {name}_b WHERE src_ip IS NOT NULL)) WHERE rn <= {k} GROUP BY domain), "
            f"{name} AS (SELECT n.domain, n.query_count, coalesce(i.source_ips, '') AS source_ips "
            f"FROM {name}_n n LEFT JOIN {name}_i i USING (domain))")


def sld_sql(x: str) -> str:
    return f"(CASE WHEN len(string_split({x}, '.')) >= 2 THEN string_split({x}, '.')[-2] ELSE string_split({x}, '.')[1] END)"


def tld_sql(x: str) -> str:
    return f"string_split({x}, '.')[-1]"


def norm_full_sql(x: str) -> str:
    return f"rtrim(trim(lower({x}), ' \t\n\r'), '.')"


def rule_tenths_sql(d: str, sld: str, ent: str) -> str:
    """M7 in tenths given normalised name, its sld and sld entropy columns."""
    return (f"((CASE WHEN {tld_sql(d)} IN {_in(dom.SUSPICIOUS_TLDS)} THEN 4 ELSE 0 END) "
            f"+ (CASE WHEN length({sld}) > 25 THEN 3 ELSE 0 END) "
            f"+ (CASE WHEN length({sld}) > 10 AND coalesce({ent}, 0) > {dom.RULE_ENTROPY} THEN 3 ELSE 0 END) "
            f"+ (CASE WHEN length({sld}) - length(replace({sld}, '-', '')) > 2 THEN 2 ELSE 0 END))")


def _top(key: str, k: int, where: str = "TRUE", out: str = "total_bytes") -> str:
    return with_flows(
        f"SELECT {key}, {out}, row_number() OVER (ORDER BY {out} DESC, {key}) AS rank FROM ("
        f"SELECT {key}, CAST(sum(bidirectional_bytes) AS BIGINT) AS {out} FROM flows "
        f"WHERE {key} IS NOT NULL AND {where} GROUP BY {key}) ORDER BY {out} DESC, {key} LIMIT {k}")


# --- query parameters shared with the catalog ------------------------------------
PORT = 443
IP = "8.8.8.8"
APP = "TLS"
FILTER = dict(dst_port=443, protocol="TLS", min_bytes=100000, min_packets=20)
EXPLORE = dict(protocol="DNS", min_packets=60)
FLOW_COLS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "application_name",
             "bidirectional_packets", "bidirectional_bytes", "bidirectional_first_seen_ms"]


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    fc = ", ".join(FLOW_COLS)
    # --- flow queries -----------------------------------------------------------
    q["filter_flows"] = with_flows(
        f"SELECT {fc} FROM flows WHERE dst_port = {FILTER['dst_port']} AND application_name = '{FILTER['protocol']}' "
        f"AND bidirectional_bytes >= {FILTER['min_bytes']} AND bidirectional_packets >= {FILTER['min_packets']}")
    q["traffic_summary"] = with_flows(
        "SELECT count(*) AS total_flows, CAST(coalesce(sum(bidirectional_packets),0) AS BIGINT) AS total_packets, "
        "CAST(coalesce(sum(bidirectional_bytes),0) AS BIGINT) AS total_bytes, count(DISTINCT src_ip) AS unique_src_ips, "
        "count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT protocol) AS unique_protocols, "
        "min(bidirectional_first_seen_ms) AS start_ms, max(bidirectional_last_seen_ms) AS end_ms, "
        "max(bidirectional_last_seen_ms) - min(bidirectional_first_seen_ms) AS duration_ms FROM flows")
    q["protocol_distribution"] = with_flows(
        "SELECT application_name, count(*) AS flow_count FROM flows WHERE application_name IS NOT NULL "
        "GROUP BY application_name ORDER BY flow_count DESC, application_name LIMIT 20")
    q["top_talkers"] = _top("src_ip", 10)
    q["top_destinations"] = _top("dst_ip", 10)
    q["port_profile_summary"] = with_flows(
        f"SELECT * FROM (SELECT count(*) AS total_flows, count(DISTINCT src_ip) AS unique_sources, "
        f"count(DISTINCT dst_ip) AS unique_destinations, CAST(coalesce(sum(bidirectional_bytes),0) AS BIGINT) AS total_bytes, "
        f"CAST(coalesce(sum(bidirectional_packets),0) AS BIGINT) AS total_packets FROM flows WHERE dst_port = {PORT}) "
        f"WHERE total_flows > 0")
    q["port_profile_top_sources"] = _top("src_ip", 5, f"dst_port = {PORT}")
    q["ip_profile_summary"] = with_flows(
        f"SELECT 'as_source' AS role, count(*) AS flow_count, CAST(coalesce(sum(bidirectional_bytes),0) AS BIGINT) AS total_bytes "
        f"FROM flows WHERE src_ip = '{IP}' UNION ALL "
        f"SELECT 'as_destination', count(*), CAST(coalesce(sum(bidirectional_bytes),0) AS BIGINT) FROM flows WHERE dst_ip = '{IP}'")
    q["ip_profile_top_peers"] = with_flows(
        f"SELECT role, peer_ip, total_bytes, rank FROM (SELECT role, peer_ip, total_bytes, "
        f"row_number() OVER (PARTITION BY role ORDER BY total_bytes DESC, peer_ip) AS rank FROM ("
        f"SELECT role, peer_ip, CAST(sum(b) AS BIGINT) AS total_bytes FROM ("
        f"SELECT 'as_source' AS role, dst_ip AS peer_ip, bidirectional_bytes AS b FROM flows WHERE src_ip = '{IP}' "
        f"UNION ALL SELECT 'as_destination', src_ip, bidirectional_bytes FROM flows WHERE dst_ip = '{IP}') "
        f"WHERE peer_ip IS NOT NULL GROUP BY role, peer_ip)) WHERE rank <= 5")
    q["app_profile_summary"] = with_flows(
        f"SELECT * FROM (SELECT count(*) AS total_flows, CAST(coalesce(sum(bidirectional_bytes),0) AS BIGINT) AS total_bytes "
        f"FROM flows WHERE application_name = '{APP}') WHERE total_flows > 0")
    q["app_profile_top_talkers"] = _top("src_ip", 10, f"application_name = '{APP}'")
    q["large_flows_summary"] = with_flows("SELECT count(*) AS flow_count FROM flows WHERE bidirectional_bytes >= 1000000")
    q["large_flows_top"] = with_flows(
        "SELECT src_ip, dst_ip, dst_port, bidirectional_bytes, bidirectional_packets FROM flows "
        "WHERE bidirectional_bytes >= 1000000 ORDER BY bidirectional_bytes DESC, src_ip, dst_ip, dst_port, "
        "bidirectional_packets LIMIT 20")
    q["explore_top_flows"] = with_flows(
        f"SELECT {fc} FROM flows WHERE application_name = '{EXPLORE['protocol']}' AND bidirectional_packets >= {EXPLORE['min_packets']} "
        f"ORDER BY bidirectional_bytes DESC NULLS LAST, src_ip, dst_ip, src_port, dst_port, bidirectional_first_seen_ms LIMIT 20")
    q["top_flows_by_packets"] = with_flows(
        f"SELECT {fc} FROM flows ORDER BY bidirectional_packets DESC NULLS LAST, bidirectional_bytes, src_ip, dst_ip, "
        f"src_port, dst_port, bidirectional_first_seen_ms LIMIT 50")
    # --- detectors ---------------------------------------------------------------
    dns = "dns AS (SELECT * FROM flows WHERE application_name = 'DNS')"
    names = "names AS (SELECT DISTINCT requested_server_name AS domain FROM dns WHERE requested_server_name IS NOT NULL)"
    ind = f"ind AS (SELECT DISTINCT rtrim(lower(value), '.') AS matched FROM ({fx.values_sql(fx.THREAT_DOMAINS, 'value')}) WHERE rtrim(lower(value), '.') <> '')"
    q["detect_threat_domains"] = with_flows(
        "SELECT m.domain, m.matched_threat_domain, s.query_count, s.source_ips FROM m JOIN st s USING (domain)",
        f"{dns}, {names}, {ind}, m AS (SELECT n.domain, arg_max(i.matched, length(i.matched)) AS matched_threat_domain "
        f"FROM names n JOIN ind i ON rtrim(lower(n.domain), '.') = i.matched "
        f"OR ends_with(rtrim(lower(n.domain), '.'), '.' || i.matched) GROUP BY n.domain), "
        + domain_stats_cte("st", "dns", "m"))
    nd = norm_full_sql("domain")
    q["detect_unknown_domains"] = with_flows(
        "SELECT f.domain, CAST(0.0 AS DOUBLE) AS ml_score, 'MEDIUM' AS severity, s.query_count, s.source_ips "
        "FROM flagged f JOIN st s USING (domain)",
        f"{dns}, {names}, nn AS (SELECT domain, {nd} AS d, {sld_sql(nd)} AS sld FROM names), "
        + entropy_cte("ne", "nn", "domain", "sld")
        + f", flagged AS (SELECT nn.domain FROM nn LEFT JOIN ne USING (domain) "
          f"WHERE {rule_tenths_sql('nn.d', 'nn.sld', 'ne.entropy')} >= {dom.RULE_SUSPICIOUS_TENTHS}), "
        + domain_stats_cte("st", "dns", "flagged"))
    q["detect_dns_tunnel"] = with_flows(
        f"SELECT dst_ip, CAST(sum(bidirectional_packets) AS BIGINT) AS packet_count FROM flows "
        f"WHERE application_name = 'DNS' AND dst_ip IS NOT NULL GROUP BY dst_ip "
        f"HAVING sum(bidirectional_packets) > {det.DNS_TUNNEL_PACKETS}")
    raw_sld = "(CASE WHEN len(string_split(domain, '.')) >= 2 THEN string_split(domain, '.')[-2] ELSE '' END)"
    q["detect_dga_domains"] = with_flows(
        f"SELECT domain, round(entropy, 6) AS entropy FROM de WHERE entropy > {det.DGA_ENTROPY}",
        f"{dns}, {names}, ds AS (SELECT domain, {raw_sld} AS sld FROM names WHERE length({raw_sld}) > {det.DGA_MIN_LENGTH}), "
        + entropy_cte("de", "ds", "domain", "sld"))
    q["detect_http_exfiltration"] = with_flows(
        f"SELECT src_ip, dst_ip, src2dst_bytes, dst2src_bytes, round(dst2src_bytes / src2dst_bytes, 6) AS ratio "
        f"FROM flows WHERE application_name IN {_in(det.HTTP_APPS)} AND src2dst_bytes > 0 "
        f"AND dst2src_bytes > src2dst_bytes * {det.HTTP_RATIO} AND dst2src_bytes > {det.HTTP_MIN_RESPONSE}")
    q["detect_uncommon_ports"] = with_flows(
        f"SELECT dst_port AS port, count(*) AS count FROM flows WHERE dst_port IS NOT NULL "
        f"AND dst_port NOT IN {_in(det.COMMON_PORTS)} GROUP BY dst_port HAVING count(*) > {det.UNCOMMON_PORT_FLOWS}")
    hits = " || ".join(f"(CASE WHEN contains(lower(user_agent), {_q(p)}) THEN [{_q(p)}] ELSE [] END)"
                       for p in det.SUSPICIOUS_UA)
    q["detect_suspicious_user_agents"] = with_flows(
        "SELECT src_ip, dst_ip, user_agent, array_to_string(h, ',') AS hits FROM "
        f"(SELECT src_ip, dst_ip, user_agent, {hits} AS h FROM flows WHERE user_agent IS NOT NULL) WHERE len(h) > 0")
    q["detect_icmp_tunnel"] = with_flows(
        f"SELECT src_ip, dst_ip, bidirectional_bytes AS bytes FROM flows WHERE protocol = 1 "
        f"AND bidirectional_bytes > {det.ICMP_MIN_BYTES}")
    q["detect_dns_exfiltration"] = with_flows(
        f"SELECT dst_ip, bidirectional_bytes AS bytes FROM flows WHERE application_name = 'DNS' "
        f"AND bidirectional_bytes > {det.DNS_EXFIL_BYTES}")
    q["detect_unknown_tls"] = with_flows(
        f"SELECT dst_ip, count(*) AS flows FROM flows WHERE application_name = 'TLS' "
        f"AND application_confidence < {det.TLS_CONFIDENCE} AND dst_ip IS NOT NULL GROUP BY dst_ip "
        f"HAVING count(*) >= {det.TLS_MIN_FLOWS}")
    q["detect_one_way_transfer"] = with_flows(
        f"SELECT dst_ip, src2dst_bytes AS bytes FROM flows WHERE src2dst_bytes > dst2src_bytes * {det.ONE_WAY_RATIO} "
        f"AND src2dst_bytes > {det.ONE_WAY_MIN_BYTES}")
    q["detect_large_transfers"] = with_flows(
        f"SELECT src_ip, dst_ip, bidirectional_bytes AS bytes FROM flows WHERE bidirectional_bytes > {det.LARGE_TRANSFER_BYTES}")
    priv = lambda c: f"coalesce(regexp_matches({c}, {_q(ipf.PRIVATE_IP_PATTERN)}), false)"
    safe = " OR ".join(f"starts_with(dst_ip, {_q(p)})" for p in ipf.SAFE_PREFIXES)
    q["detect_suspicious_communication"] = with_flows(
        f"SELECT src_ip, dst_ip, bidirectional_packets AS packets FROM flows WHERE {priv('src_ip')} "
        f"AND NOT {priv('dst_ip')} AND NOT coalesce({safe}, false) AND bidirectional_packets > {det.SUSPICIOUS_COMM_PACKETS}")
    q["detect_port_scan"] = with_flows(
        f"SELECT src_ip, count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS targets, "
        f"CAST(coalesce(sum(bidirectional_packets),0) AS BIGINT) AS packets FROM flows WHERE src_ip IS NOT NULL "
        f"GROUP BY src_ip HAVING count(DISTINCT dst_port) > {det.SCAN_MIN_PORTS} AND count(DISTINCT dst_ip) < {det.SCAN_MAX_TARGETS}")
    t = det.PLUGIN_SCAN_THRESHOLD
    q["detect_plugin_port_scan"] = with_flows(
        f"SELECT c.src_ip, c.port_count, s.sample_ports, round(least(1.0, c.port_count / (2.0 * {t})), 6) AS confidence "
        f"FROM c JOIN s USING (src_ip)",
        f"p AS (SELECT DISTINCT src_ip, dst_port FROM flows WHERE src_ip IS NOT NULL AND src_ip <> '' "
        f"AND dst_port IS NOT NULL AND dst_port <> 0), "
        f"c AS (SELECT src_ip, count(*) AS port_count FROM p GROUP BY src_ip HAVING count(*) >= {t}), "
        f"s AS (SELECT src_ip, string_agg(CAST(dst_port AS VARCHAR), ',' ORDER BY dst_port) AS sample_ports FROM ("
        f"SELECT src_ip, dst_port, row_number() OVER (PARTITION BY src_ip ORDER BY dst_port) AS rn FROM p) "
        f"WHERE rn <= {det.PLUGIN_SCAN_SAMPLE} GROUP BY src_ip)")
    q["domain_features"] = domain_feature_sql()
    q["domain_rule_score"] = rule_score_sql()
    labelled = ("SELECT DISTINCT requested_server_name AS domain, CASE WHEN ends_with(requested_server_name, '.xyz') THEN 1.0::DOUBLE "
                "ELSE 0.0::DOUBLE END AS label FROM flows WHERE requested_server_name IS NOT NULL")
    q["domain_model_split"] = with_flows(
        "SELECT domain, label, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER "
        "(PARTITION BY label ORDER BY md5('42:' || domain), domain) AS r, count(*) OVER (PARTITION BY label) AS n FROM d)", f"d AS ({labelled})")
    q["domain_rule_evaluation"] = (
        "SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, round(sum(p * (below + n / 2.0)) / "
        "(sum(p) * sum(n)), 9) AS auc FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND "
        "1 PRECEDING), 0) AS below FROM (SELECT rule_score AS score, count(*) FILTER (ends_with(domain, '.xyz')) AS p, "
        f"count(*) FILTER (NOT ends_with(domain, '.xyz')) AS n FROM ({q['domain_rule_score']}) GROUP BY rule_score))")
    q.update(anomaly_sql())
    q.update(reputation_sql())
    q.update(graph_sql())
    q.update(indicator_sql())
    q.update(alert_sql(q))
    q["flow_metering"] = metering_sql()
    q["flow_metering_fine_buckets"] = metering_sql()
    q.update(streaming_sql(q))
    q.update(surface_sql(q))
    q["stream_flow_metering"] = metering_sql(places=1)
    return q


# --- domain features and rule score (F1-F8, M6, M7) ------------------------------

def _names_features_ctes() -> str:
    nd = norm_full_sql("domain")
    return (
        "names AS (SELECT DISTINCT requested_server_name AS domain FROM flows WHERE requested_server_name IS NOT NULL), "
        f"nn0 AS (SELECT domain, {nd} AS d FROM names), "
        f"nn AS (SELECT domain, d, {sld_sql('d')} AS sld, {tld_sql('d')} AS tld, len(string_split(d, '.')) AS nparts FROM nn0), "
        + entropy_cte("fe", "nn", "domain", "sld") + ", "
        "pos AS (SELECT domain, i, substr(sld, CAST(i AS INTEGER), 1) AS ch FROM "
        "(SELECT domain, sld, unnest(range(1, length(sld) + 1)) AS i FROM nn)), "
        "lagged AS (SELECT domain, i, ch, lag(ch) OVER (PARTITION BY domain ORDER BY i) AS prev FROM pos), "
        "runs AS (SELECT domain, sum(CASE WHEN prev IS NULL OR prev <> ch THEN 1 ELSE 0 END) "
        "OVER (PARTITION BY domain ORDER BY i) AS rid FROM lagged), "
        "mr AS (SELECT domain, max(cnt) AS mc FROM (SELECT domain, rid, count(*) AS cnt FROM runs GROUP BY domain, rid) "
        "GROUP BY domain), "
        "tr AS (SELECT domain, sum(CASE WHEN (regexp_full_match(ch, '\\p{Nd}') AND regexp_full_match(prev, '\\p{L}')) "
        "OR (regexp_full_match(ch, '\\p{L}') AND regexp_full_match(prev, '\\p{Nd}')) THEN 1 ELSE 0 END) AS tn "
        "FROM lagged WHERE prev IS NOT NULL GROUP BY domain)")


def _cnt(x: str, cls: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{cls}', '', 'g')))"


def _ratio(num: str, den: str) -> str:
    return f"(CASE WHEN length({den}) > 0 THEN {num} / length({den}) ELSE 0.0 END)"


def domain_feature_sql() -> str:
    feats = (
        "CAST(length(d) AS INTEGER) AS domain_length, CAST(length(sld) AS INTEGER) AS sld_length, "
        "CAST(length(tld) AS INTEGER) AS tld_length, CAST(greatest(nparts - 2, 0) AS INTEGER) AS subdomain_count, "
        f"CASE WHEN tld IN {_in(dom.COMMON_TLDS)} THEN 1 ELSE 0 END AS tld_is_common, "
        "round(coalesce(fe.entropy, 0.0), 6) AS sld_entropy, "
        f"round({_ratio(_cnt('sld', chr(92) + 'p{Nd}'), 'sld')}, 6) AS digit_ratio, "
        f"round({_ratio(_cnt('sld', chr(92) + 'p{L}'), 'sld')}, 6) AS alpha_ratio, "
        f"CAST({_cnt('sld', '-')} AS INTEGER) AS hyphen_count, "
        f"CASE WHEN {_cnt('sld', chr(92) + 'p{Nd}')} > 0 THEN 1 ELSE 0 END AS has_digit, "
        "CAST(coalesce(mr.mc, 1) AS INTEGER) AS max_consecutive, "
        f"round({_ratio(_cnt('d', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{Nd}.' + chr(92) + '-]'), 'd')}, 6) AS special_char_ratio, "
        f"round({_ratio('coalesce(tr.tn, 0)', 'sld')}, 6) AS transition_ratio, "
        f"round({_ratio(_cnt('sld', '[aeiou]'), 'sld')}, 6) AS vowel_ratio, "
        f"CASE WHEN regexp_full_match(d, '{chr(92)}d{{1,3}}({chr(92)}.{chr(92)}d{{1,3}}){{3}}') THEN 1 ELSE 0 END AS is_ip")
    return with_flows(
        f"SELECT nn.domain, {feats} FROM nn LEFT JOIN fe USING (domain) LEFT JOIN mr USING (domain) "
        f"LEFT JOIN tr USING (domain)", _names_features_ctes())


def rule_score_sql() -> str:
    t = rule_tenths_sql("nn.d", "nn.sld", "fe.entropy")
    return with_flows(
        f"SELECT nn.domain, round(least({t} / 10.0, 1.0), 6) AS rule_score, "
        f"{t} >= {dom.RULE_SUSPICIOUS_TENTHS} AS is_suspicious FROM nn LEFT JOIN fe USING (domain)",
        _names_features_ctes())


# --- anomaly (P13, M1, M2, M3, A13) ----------------------------------------------

def _scored_ctes() -> str:
    cols = {"b": "bidirectional_bytes", "p": "bidirectional_packets", "d": "bidirectional_duration_ms"}
    x = {k: f"coalesce(CAST({c} AS DOUBLE), 0.0)" for k, c in cols.items()}
    med = ", ".join(f"quantile_cont({x[k]}, 0.5) AS m{k}" for k in cols)
    mad = ", ".join(f"quantile_cont(abs({x[k]} - m{k}), 0.5) AS a{k}" for k in cols)
    raw = " + ".join(f"(CASE WHEN a{k} > 0 THEN abs(({x[k]} - m{k}) / a{k}) ELSE 0.0 END)" for k in cols)
    return (f"med AS (SELECT {med} FROM flows), mad AS (SELECT {mad} FROM flows, med), "
            f"raw AS (SELECT f.*, 0.0 + {raw} AS raw FROM flows f, med, mad), "
            "mx AS (SELECT max(raw) AS mx FROM raw), "
            "scored AS (SELECT raw.*, CASE WHEN mx > 0 THEN raw / mx ELSE raw END AS anomaly_score FROM raw, mx), "
            "thr AS (SELECT quantile_cont(anomaly_score, 0.95) AS thr FROM scored), "
            "flagged AS (SELECT scored.*, anomaly_score >= thr AS is_anomaly FROM scored, thr)")


def anomaly_sql() -> dict[str, str]:
    from netsift.operators import anomaly as an
    q = {}
    q["anomaly_scores"] = with_flows(
        "SELECT src_ip, dst_ip, dst_port, bidirectional_bytes, round(anomaly_score, 6) AS anomaly_score, is_anomaly "
        "FROM flagged", _scored_ctes())
    q["anomaly_summary"] = with_flows(
        "SELECT count(*) AS total_flows, count(*) FILTER (WHERE is_anomaly) AS anomaly_count, "
        "round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE is_anomaly) * 100.0 / count(*) ELSE 0.0 END, 6) "
        "AS anomaly_rate FROM flagged", _scored_ctes())
    q["anomaly_top"] = with_flows(
        "SELECT src_ip, dst_ip, dst_port, bidirectional_bytes, round(anomaly_score, 6) AS anomaly_score FROM flagged "
        "WHERE is_anomaly ORDER BY anomaly_score DESC, bidirectional_bytes DESC, src_ip, dst_ip, dst_port LIMIT 20",
        _scored_ctes())
    x = {c: f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in an.ML_FEATURES}
    st = ", ".join(f"avg({x[c]}) AS m_{c}, stddev_pop({x[c]}) AS s_{c}" for c in an.ML_FEATURES)
    sc = ", ".join(f"round(({x[c]} - m_{c}) / (CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END), 4) + 0.0 AS {c}"
                   for c in an.ML_FEATURES)  # + 0.0 turns a rounded -0.0 into 0.0, as Spark's round does
    q["standard_scaled_features"] = with_flows(
        f"SELECT src_ip, dst_ip, {sc} FROM flows, st", f"st AS (SELECT {st} FROM flows)")
    return q


# --- reputation (C1-C8, J6-J9, D16-D18) -------------------------------------------

def ipv4_long_sql(x: str) -> str:
    p = lambda i: f"CAST(string_split({x}, '.')[{i}] AS BIGINT)"
    return (f"(CASE WHEN regexp_full_match({x}, {_q(ipf.IPV4_STRICT[1:-1])}) THEN "
            f"{p(1)} * 16777216 + {p(2)} * 65536 + {p(3)} * 256 + {p(4)} END)")


def _ranges_sql(v: str, ranges) -> str:
    return "(" + " OR ".join(f"{v} BETWEEN {lo} AND {hi}" for lo, hi in ranges) + ")" if ranges else "false"


def external_sql(x: str) -> str:
    v = ipv4_long_sql(x)
    priv = f"({_ranges_sql(v, ipf.V4_PRIVATE)} AND NOT {_ranges_sql(v, ipf.V4_PRIVATE_EXCEPT)})"
    return (f"coalesce({v} IS NOT NULL AND NOT ({priv} OR {_ranges_sql(v, ipf.V4_LOOPBACK)} "
            f"OR {_ranges_sql(v, ipf.V4_LINK_LOCAL)}), false)")


def level_sql(score: str, isp: str) -> str:
    from netsift.operators import reputation as rp
    cloud = " OR ".join(f"contains(coalesce({isp}, ''), {_q(c)})" for c in rp.KNOWN_CLOUD_PROVIDERS)
    score = f"coalesce({score}, 0)"
    return (f"(CASE WHEN {score} < {rp.SAFE_BELOW} AND {score} = {rp.WHITELIST_SCORE} AND ({cloud}) THEN 'whitelist' "
            f"WHEN {score} < {rp.SAFE_BELOW} THEN 'safe' WHEN {score} >= {rp.THREAT_AT} THEN 'malicious' END)")


def live_sql(level: str, age: str) -> str:
    from netsift.operators import reputation as rp
    parts = " ".join(f"WHEN {_q(l)} THEN {'true' if t is None else f'{age} < {t}'}" for l, t in rp.TTL_DAYS.items())
    return f"(CASE {level} {parts} ELSE false END)"


def _order_sql(level: str, order) -> str:
    return "(CASE " + " ".join(f"WHEN {level} = {_q(l)} THEN {i}" for i, l in enumerate(order)) + f" ELSE {len(order)} END)"


def reputation_sql() -> dict[str, str]:
    from netsift.operators import reputation as rp
    base = (f"rep AS ({fx.ip_reputation_sql('duckdb')}), "
            f"cache AS (SELECT ip AS key, {level_sql('abuse_score', 'isp')} AS level, age_days, abuse_score, isp FROM rep), "
            f"live AS (SELECT * FROM cache WHERE {live_sql('level', 'age_days')}), "
            f"ext AS (SELECT DISTINCT dst_ip AS key FROM flows WHERE dst_ip IS NOT NULL AND {external_sql('dst_ip')}), "
            f"tiers AS (SELECT key AS ip, level AS tier, abuse_score, isp, age_days FROM (SELECT l.*, row_number() OVER "
            f"(PARTITION BY key ORDER BY {_order_sql('level', rp.TIER_ORDER)}, age_days) AS rn FROM live l "
            f"WHERE key IN (SELECT key FROM ext)) WHERE rn = 1), "
            f"pending AS (SELECT key AS ip FROM ext WHERE key NOT IN (SELECT key FROM live)), "
            f"lookup AS (SELECT p.ip, r.abuse_score, r.isp, {level_sql('r.abuse_score', 'r.isp')} AS level "
            f"FROM pending p JOIN rep r ON p.ip = r.ip), "
            f"mal AS (SELECT ip, abuse_score, isp, CASE WHEN abuse_score >= {rp.HIGH_AT} THEN 'HIGH' ELSE 'MEDIUM' END "
            f"AS severity, CASE WHEN abuse_score >= {rp.HIGH_AT} THEN 0.95 ELSE 0.7 END AS confidence "
            f"FROM lookup WHERE level = 'malicious')")
    q = {}
    seen = "key IN (SELECT dst_ip FROM flows WHERE dst_ip IS NOT NULL)"
    q["reputation_cache_remove"] = with_flows(f"SELECT key, level, age_days FROM cache WHERE NOT ({seen})", base)
    q["reputation_cache_remove_level"] = with_flows(
        f"SELECT key, level, age_days FROM cache WHERE NOT (level = 'malicious' AND {seen})", base)
    q["reputation_cache_clear_level"] = with_flows("SELECT key, level, age_days FROM cache WHERE level <> 'safe'", base)
    q["ip_reputation_tiers"] = with_flows("SELECT ip, tier, abuse_score, age_days FROM tiers", base)
    q["ip_pending_lookups"] = with_flows("SELECT ip FROM pending", base)
    q["detect_malicious_ips"] = with_flows(
        "SELECT ip, abuse_score, isp, severity, CAST(confidence AS DOUBLE) AS confidence FROM mal", base)
    q["malicious_ip_listing"] = with_flows(
        "SELECT ip, abuse_score, 'cache' AS origin FROM tiers WHERE tier = 'malicious' "
        "UNION ALL SELECT ip, abuse_score, 'lookup' FROM mal", base)
    q["reputation_cache_get"] = with_flows(
        f"SELECT key, level, age_days FROM (SELECT l.*, row_number() OVER (PARTITION BY key ORDER BY "
        f"{_order_sql('level', rp.GET_ORDER)}, age_days) AS rn FROM live l WHERE key IN "
        f"(SELECT dst_ip FROM flows)) WHERE rn = 1", base)
    q["reputation_cache_upsert"] = with_flows(
        "SELECT key, level, age_days, abuse_score FROM (SELECT *, row_number() OVER (PARTITION BY key, level "
        "ORDER BY src DESC, age_days) AS rn FROM (SELECT key, level, age_days, abuse_score, 0 AS src FROM cache "
        "UNION ALL SELECT ip, level, 0, abuse_score, 1 FROM lookup)) WHERE rn = 1", base)
    q["reputation_cache_expire"] = with_flows(
        f"SELECT level, count(*) FILTER (WHERE NOT {live_sql('level', 'age_days')}) AS removed FROM cache GROUP BY level",
        base)
    q["reputation_cache_stats"] = with_flows(
        "SELECT hits, misses, whitelist_size, safe_size, malicious_size, "
        "round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 0.0 END, 6) AS hit_rate FROM ("
        "SELECT count(*) FILTER (WHERE h.key IS NOT NULL) AS hits, count(*) FILTER (WHERE h.key IS NULL) AS misses, "
        "(SELECT count(*) FROM cache WHERE level = 'whitelist') AS whitelist_size, "
        "(SELECT count(*) FROM cache WHERE level = 'safe') AS safe_size, "
        "(SELECT count(*) FROM cache WHERE level = 'malicious') AS malicious_size "
        "FROM flows f LEFT JOIN (SELECT DISTINCT key FROM live) h ON f.dst_ip = h.key)", base)
    q["ip_cache_hours_live"] = with_flows(
        f"SELECT key, level FROM cache WHERE age_days * 24 <= {rp.IP_CACHE_TTL_HOURS}", base)
    q["safe_list_days_left"] = with_flows(
        f"SELECT key, {rp.SAFE_DOMAIN_TTL_DAYS} - age_days AS days_left FROM cache WHERE level = 'safe' "
        f"AND {rp.SAFE_DOMAIN_TTL_DAYS} - age_days > 0", base)
    q["reputation_lookup_stats"] = with_flows(
        "SELECT (SELECT count(*) FROM cache WHERE level = 'whitelist') AS whitelist_size, "
        "(SELECT count(*) FROM cache WHERE level = 'safe') AS safe_size, "
        "(SELECT count(*) FROM cache WHERE level = 'malicious') AS malicious_size, "
        "(SELECT count(*) FROM lookup) AS api_queries, (SELECT count(*) FROM tiers) AS cache_hits", base)
    # domain triage
    nd = "rtrim(lower(requested_server_name), '.')"
    safe = fx.values_sql(rp.SAFE_DOMAIN_KEYWORDS, "s")
    nf = norm_full_sql("domain")
    dbase = (f"cand AS (SELECT DISTINCT {nd} AS domain FROM flows WHERE application_name = 'DNS' "
             f"AND requested_server_name IS NOT NULL), "
             f"cand2 AS (SELECT domain, {nf} AS d FROM cand WHERE NOT EXISTS (SELECT 1 FROM ({safe}) sk "
             f"WHERE cand.domain = sk.s OR ends_with(cand.domain, '.' || sk.s))), "
             f"cand3 AS (SELECT domain, d, {sld_sql('d')} AS sld FROM cand2), "
             + entropy_cte("ge", "cand3", "domain", "sld") + ", "
             f"gated AS (SELECT cand3.domain FROM cand3 LEFT JOIN ge USING (domain) "
             f"WHERE {rule_tenths_sql('cand3.d', 'cand3.sld', 'ge.entropy')} >= {dom.RULE_SUSPICIOUS_TENTHS}), "
             f"drep AS (SELECT rtrim(lower(domain), '.') AS domain, severity, judgment, is_malicious FROM "
             f"({fx.domain_reputation_sql('duckdb')})), "
             f"tri AS (SELECT g.domain, r.severity, r.judgment, r.is_malicious, r.severity = 'suspicious' AS is_suspicious, "
             f"CASE WHEN r.judgment = 'Whitelist' THEN 'whitelist' WHEN NOT r.is_malicious AND NOT (r.severity = 'suspicious') "
             f"THEN 'safe' ELSE 'threat' END AS outcome FROM gated g JOIN drep r USING (domain)), "
             f"dnsn AS (SELECT {nd} AS nname, * FROM flows WHERE application_name = 'DNS'), "
             f"thr AS (SELECT domain FROM tri WHERE outcome = 'threat'), "
             + domain_stats_cte("dst", "dnsn", "thr", key="nname"))
    q["domain_candidates"] = with_flows("SELECT domain FROM cand", dbase)
    q["domain_gate"] = with_flows("SELECT domain FROM gated", dbase)
    drep = f"({fx.domain_reputation_sql('duckdb')})"
    q["domain_gate_lists"] = with_flows(
        f"SELECT domain FROM gated WHERE domain NOT IN (SELECT domain FROM {drep} WHERE judgment = 'Whitelist') "
        f"AND domain NOT IN (SELECT domain FROM {drep} WHERE judgment <> 'Whitelist' AND severity = 'info' "
        f"AND ascii(domain) * 7 % 60 < {rp.SAFE_DOMAIN_TTL_DAYS})", dbase)
    q["domain_triage"] = with_flows("SELECT domain, severity, judgment, outcome FROM tri", dbase)
    q["detect_domain_threats"] = with_flows(
        "SELECT t.domain, t.severity, t.judgment, CASE WHEN t.is_malicious THEN 'HIGH' ELSE 'MEDIUM' END AS alert_severity, "
        "CAST(CASE WHEN t.is_malicious THEN 0.95 ELSE 0.7 END AS DOUBLE) AS confidence, coalesce(s.query_count, 0) AS query_count, "
        "coalesce(s.source_ips, '') AS source_ips FROM tri t LEFT JOIN dst s USING (domain) WHERE t.outcome = 'threat'",
        dbase)
    return q


# --- graph (P7, P8, A14, J10, J11, G1-G5) ----------------------------------------

def graph_valid_sql(x: str) -> str:
    s = f"trim({x})"
    v = ipv4_long_sql(s)
    bad = (f"({_ranges_sql(v, ipf.V4_MULTICAST)} OR {_ranges_sql(v, ipf.V4_LINK_LOCAL)} "
           f"OR {_ranges_sql(v, ipf.V4_RESERVED)} OR {v} = 0)")
    return (f"coalesce({s} <> '' AND {s} NOT IN {_in(ipf.GRAPH_DROP)} AND NOT ends_with({s}, '.255') "
            f"AND {v} IS NOT NULL AND NOT {bad}, false)")


def category_sql(x: str) -> str:
    v = ipv4_long_sql(x)
    priv = f"coalesce({v} IS NOT NULL AND {_ranges_sql(v, ipf.V4_PRIVATE)} AND NOT {_ranges_sql(v, ipf.V4_PRIVATE_EXCEPT)}, false)"
    return (f"(CASE WHEN {priv} AND (ends_with({x}, '.1') OR ends_with({x}, '.254')) THEN 'Gateway/Router' "
            f"WHEN {priv} THEN 'Internal Host' WHEN {x} IN {_in(ipf.PUBLIC_DNS)} THEN 'Public DNS' "
            f"ELSE 'External Server' END)")


def _graph_base() -> str:
    return (f"clean AS (SELECT * FROM flows WHERE {graph_valid_sql('src_ip')} AND {graph_valid_sql('dst_ip')}), "
            "edges AS (SELECT src_ip AS source, dst_ip AS target, CAST(coalesce(sum(bidirectional_bytes), 0) AS BIGINT) AS value, "
            "substr(coalesce(array_to_string(list_sort(list_distinct(list(application_name) FILTER "
            "(WHERE application_name IS NOT NULL AND application_name <> ''))), ', '), ''), 1, 30) AS label "
            "FROM clean GROUP BY src_ip, dst_ip), "
            "st AS (SELECT src_ip AS id, sum(bidirectional_bytes) AS b FROM clean GROUP BY src_ip), "
            "dt AS (SELECT dst_ip AS id, sum(bidirectional_bytes) AS b FROM clean GROUP BY dst_ip), "
            "traffic AS (SELECT coalesce(st.id, dt.id) AS id, CAST(greatest(coalesce(st.b, 0), coalesce(dt.b, 0)) AS BIGINT) "
            "AS traffic FROM st FULL JOIN dt ON st.id = dt.id)")


def _ip_nodes_sql(edges: str, bad: str | None) -> str:
    badj = f"LEFT JOIN (SELECT DISTINCT id FROM {bad}) bad ON bad.id = ids.id" if bad else ""
    isbad = "bad.id IS NOT NULL" if bad else "false"
    return (f"SELECT ids.id, 'ip' AS type, CASE WHEN {isbad} THEN 'Threat Node' ELSE {category_sql('ids.id')} END "
            f"AS category, coalesce(t.traffic, 0) AS value, "
            f"round(least(greatest(pow(CAST(coalesce(t.traffic, 0) AS DOUBLE), 0.35), 15.0), 70.0), 6) AS size, "
            f"(coalesce(t.traffic, 0) > 100000 OR {isbad}) AS show_label, {isbad} AS is_bad_actor "
            f"FROM (SELECT source AS id FROM {edges} UNION SELECT target FROM {edges}) ids "
            f"LEFT JOIN traffic t ON t.id = ids.id {badj}")


def graph_sql() -> dict[str, str]:
    from netsift.operators import graph as gr
    q = {}
    base = _graph_base()
    full = f"kept AS (SELECT * FROM edges WHERE value >= {gr.DEFAULT_MIN_BYTES})"
    q["graph_edges_full"] = with_flows(
        "SELECT source, target, value, label, false AS is_highlighted, 'ip' AS kind, "
        "round(least(value / 1e6 + 1.0, 6.0), 6) AS width FROM kept", base + ", " + full)
    q["graph_nodes_full"] = with_flows(_ip_nodes_sql("kept", None), base + ", " + full)
    def highlighted(sets: str) -> tuple[str, str]:
        """SQL of edges and nodes for CTEs hip(value) and hd(domain)."""
        thr = (sets + ", names AS (SELECT DISTINCT src_ip AS source, dst_ip AS target, lower(requested_server_name) AS sni FROM clean "
               "WHERE requested_server_name IS NOT NULL AND requested_server_name <> ''), "
               "nm AS (SELECT n.source, n.target, n.sni, arg_max(hd.domain, length(hd.domain)) AS domain FROM names n "
               "JOIN hd ON n.sni = hd.domain OR ends_with(n.sni, '.' || hd.domain) GROUP BY n.source, n.target, n.sni), "
               "matches AS (SELECT source, target, domain FROM nm), "
               "ipe AS (SELECT e.* FROM edges e WHERE e.source IN (SELECT value FROM hip) OR e.target IN (SELECT value FROM hip) "
               "OR EXISTS (SELECT 1 FROM matches m WHERE m.source = e.source AND m.target = e.target)), "
               "de AS (SELECT m.source, m.domain AS target, e.value FROM matches m JOIN edges e "
               "ON m.source = e.source AND m.target = e.target), "
               "badset AS (SELECT source AS id FROM de UNION SELECT value FROM hip)")
        return (with_flows("SELECT source, target, value, label, true AS is_highlighted, 'ip' AS kind, "
                           "round(least(value / 1e6 + 1.0, 6.0), 6) AS width FROM ipe UNION ALL "
                           f"SELECT source, target, value, '{gr.DOMAIN_EDGE_LABEL}', true, 'domain', 3.0 FROM de", base + ", " + thr),
                with_flows(_ip_nodes_sql("ipe", "badset") + " UNION ALL SELECT DISTINCT target, 'domain', 'Domain', "
                           f"CAST(0 AS BIGINT), {float(gr.DOMAIN_NODE_SIZE)}, true, false FROM de", base + ", " + thr))

    q["graph_edges_threat"], q["graph_nodes_threat"] = highlighted(
        f"rep AS ({fx.ip_reputation_sql('duckdb')}), "
        f"hip AS (SELECT DISTINCT ip AS value FROM rep WHERE {level_sql('abuse_score', 'isp')} = 'malicious'), "
        f"hd AS (SELECT DISTINCT lower(value) AS domain FROM ({fx.values_sql(fx.THREAT_DOMAINS, 'value')}) WHERE lower(value) <> '')")
    # G5 over the alerts of D1, D3 and D14
    d1 = ("SELECT [domain, matched_threat_domain, CAST(query_count AS VARCHAR), source_ips] AS ev, "
          "printf('Access to threat domain %s (matches %s)', domain, matched_threat_domain) AS descr, "
          "domain AS evdom, [domain, matched_threat_domain] AS ioc FROM d1")
    d3 = ("SELECT [dst_ip, CAST(packet_count AS VARCHAR)], printf('Possible DNS tunnel via %s (%d packets)', dst_ip, "
          "packet_count), NULL, [dst_ip] FROM d3")
    d14 = ("SELECT [src_ip, CAST(ports AS VARCHAR), CAST(targets AS VARCHAR)], "
           "printf('Port scan: %s probed %d ports on %d targets', src_ip, ports, targets), NULL, [src_ip] FROM d14")
    src = oracle_sql_parts()
    al = (src + f", alerts AS ({d1} UNION ALL {d3} UNION ALL {d14}), "
          "texts AS (SELECT unnest(list_append(ev, descr)) AS t FROM alerts), "
          "iocs AS (SELECT unnest(ioc) AS v FROM alerts)")
    ipre = gr.IP_TEXT_PATTERN
    dre = gr.DOMAIN_TEXT_PATTERN
    looks_ip = lambda x: (f"(regexp_matches({x}, '^(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b') AND "  # noqa: E731
                          f"length({x}) - length(replace({x}, '.', '')) = 3)")
    valid = lambda x: (f"(trim(lower({x})) <> '' AND contains(trim(lower({x})), '.') AND NOT ends_with(trim(lower({x})), '.') "  # noqa: E731
                       f"AND NOT {looks_ip(f'trim(lower({x}))')})")
    q["alert_ioc_ips"] = with_flows(
        f"SELECT DISTINCT value FROM (SELECT unnest(regexp_extract_all(t, {_q(ipre)})) AS value FROM texts "
        f"WHERE t IS NOT NULL UNION ALL SELECT v FROM iocs WHERE v IS NOT NULL AND {looks_ip('v')})", al)
    q["alert_ioc_domains"] = with_flows(
        f"SELECT DISTINCT value FROM (SELECT lower(d) AS value FROM (SELECT unnest(regexp_extract_all(t, {_q(dre)})) AS d "
        f"FROM texts WHERE t IS NOT NULL) WHERE {valid('d')} "
        f"UNION ALL SELECT evdom FROM alerts WHERE evdom IS NOT NULL AND {valid('evdom')} "
        f"UNION ALL SELECT lower(v) FROM iocs WHERE v IS NOT NULL AND NOT {looks_ip('v')} AND {valid('v')})", al)
    # all alerts of D1, D3 and D14 are HIGH, so the anomaly graph highlights all that they mention
    q["graph_edges_anomaly"], q["graph_nodes_anomaly"] = highlighted(
        f"hip AS ({q['alert_ioc_ips']}), hd AS (SELECT value AS domain FROM ({q['alert_ioc_domains']}))")
    return q


def oracle_sql_parts() -> str:
    """CTEs d1, d3, d14: the findings of three detectors (for G5)."""
    dns = "dns AS (SELECT * FROM flows WHERE application_name = 'DNS')"
    names = "names AS (SELECT DISTINCT requested_server_name AS domain FROM dns WHERE requested_server_name IS NOT NULL)"
    ind = (f"ind AS (SELECT DISTINCT rtrim(lower(value), '.') AS matched FROM ({fx.values_sql(fx.THREAT_DOMAINS, 'value')}) "
           f"WHERE rtrim(lower(value), '.') <> '')")
    return (f"{dns}, {names}, {ind}, m AS (SELECT n.domain, arg_max(i.matched, length(i.matched)) AS matched_threat_domain "
            f"FROM names n JOIN ind i ON rtrim(lower(n.domain), '.') = i.matched "
            f"OR ends_with(rtrim(lower(n.domain), '.'), '.' || i.matched) GROUP BY n.domain), "
            + domain_stats_cte("st", "dns", "m")
            + ", d1 AS (SELECT m.domain, m.matched_threat_domain, s.query_count, s.source_ips FROM m JOIN st s USING (domain)), "
            f"d3 AS (SELECT dst_ip, CAST(sum(bidirectional_packets) AS BIGINT) AS packet_count FROM flows "
            f"WHERE application_name = 'DNS' AND dst_ip IS NOT NULL GROUP BY dst_ip "
            f"HAVING sum(bidirectional_packets) > {det.DNS_TUNNEL_PACKETS}), "
            f"d14 AS (SELECT src_ip, count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS targets FROM flows "
            f"WHERE src_ip IS NOT NULL GROUP BY src_ip HAVING count(DISTINCT dst_port) > {det.SCAN_MIN_PORTS} "
            f"AND count(DISTINCT dst_ip) < {det.SCAN_MAX_TARGETS})")


# --- indicators and feeds (S4-S10, I1-I6, A15, F11, J2-J5, J12, J13) ----------------

def indicator_sql() -> dict[str, str]:
    from netsift.plans.catalog import NOW_EPOCH, WHITELIST_IP_PREFIXES
    from netsift.sources.builtin import (BUILTIN_PHISHING_KEYWORDS, BUILTIN_SAFE_DOMAINS, BUILTIN_SOURCES,
                                         BUILTIN_SUSPICIOUS_UA)
    N = NOW_EPOCH
    names = "names AS (SELECT DISTINCT requested_server_name AS value FROM flows WHERE requested_server_name IS NOT NULL)"
    hosts = ("hosts AS (SELECT DISTINCT value FROM (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) "
             "AS value FROM pages) WHERE value <> '')")
    built = " UNION ALL ".join(
        f"SELECT {_q(src)} AS source, {_q(cat)} AS category, v AS value, {N} AS added_epoch FROM "
        f"({fx.values_sql(items, 'v')})" for src, cat, items in BUILTIN_SOURCES)
    base = (f"{names}, {hosts}, rep AS ({fx.ip_reputation_sql('duckdb')}), "
            f"base AS (SELECT 'reputation_feed' AS source, 'threat_ips' AS category, ip AS value, "
            f"CAST({N} - age_days * 24 * 3600 AS BIGINT) AS added_epoch FROM rep WHERE abuse_score >= 10 "
            f"UNION ALL SELECT 'domain_feed', 'threat_domains', value, CAST({N} - (length(value) % 48) * 3600 AS BIGINT) "
            f"FROM names UNION ALL SELECT 'url_feed', 'threat_urls', value, CAST({N} - (length(value) % 72) * 3600 AS BIGINT) "
            f"FROM (SELECT DISTINCT url AS value FROM pages WHERE {fx.THREAT_URL_RULE}) UNION ALL {built}), "
            "feeds AS (SELECT * FROM (VALUES ('reputation_feed', true), ('domain_feed', true), ('url_feed', false)"
            + "".join(f", ({_q(src)}, true)" for src, _, _ in BUILTIN_SOURCES) + ") f(source, enabled))")
    q = {}
    q["feed_text_items"] = with_flows("SELECT value FROM names", names)
    q["feed_gzip_items"] = with_flows("SELECT value FROM names", names)
    q["feed_hosts_items"] = with_flows(
        "SELECT DISTINCT lower(requested_server_name) AS value FROM flows WHERE requested_server_name IS NOT NULL")
    q["feed_csv_items"] = with_flows(
        "SELECT DISTINCT trim(url) AS value FROM pages WHERE trim(url) <> '' AND NOT starts_with(trim(url), '#')")
    q["feed_json_items"] = with_flows("SELECT value FROM names", names)
    safe = (f"vals AS (SELECT value FROM names UNION SELECT value FROM hosts), "
            f"items AS (SELECT v AS i FROM ({fx.values_sql(BUILTIN_SAFE_DOMAINS, 'v')}) UNION "
            f"SELECT domain FROM ({fx.domain_reputation_sql('duckdb')}) WHERE judgment = 'Whitelist' UNION "
            f"SELECT regexp_replace(value, '^[^.]*\\.', '') FROM hosts WHERE len(string_split(value, '.')) >= 3)")
    q["safe_domain_lookup"] = with_flows(
        "SELECT value FROM vals WHERE EXISTS (SELECT 1 FROM items WHERE vals.value = items.i "
        "OR lower(vals.value) = items.i OR ends_with(lower(vals.value), '.' || items.i))", f"{names}, {hosts}, {safe}")
    q["whitelist_ip_prefix_lookup"] = with_flows(
        f"SELECT DISTINCT src_ip AS value FROM flows WHERE src_ip IS NOT NULL AND EXISTS (SELECT 1 FROM "
        f"({fx.values_sql(WHITELIST_IP_PREFIXES, 'p')}) pp WHERE pp.p <> '' AND starts_with(flows.src_ip, pp.p))")
    q["ua_keyword_lookup"] = with_flows(
        "SELECT v.value, string_agg(i.item, ',' ORDER BY i.item) AS matched FROM "
        "(SELECT user_agent AS value FROM flows WHERE user_agent IS NOT NULL UNION SELECT url FROM pages) v "
        f"JOIN (SELECT DISTINCT lower(x) AS item FROM ({fx.values_sql(BUILTIN_SUSPICIOUS_UA + BUILTIN_PHISHING_KEYWORDS, 'x')}) "
        "WHERE lower(x) <> '') i ON contains(lower(v.value), i.item) GROUP BY v.value")
    q["exact_indicator_lookup"] = with_flows(
        "SELECT dst_ip, count(*) AS flows FROM flows WHERE dst_ip IN (SELECT b.value FROM base b JOIN feeds f "
        "USING (source) WHERE f.enabled AND b.category = 'threat_ips') GROUP BY dst_ip", base)
    q["indicator_snapshot_replace"] = with_flows(
        "SELECT * FROM base WHERE source <> 'domain_feed' UNION ALL SELECT 'domain_feed', 'threat_domains', value, "
        f"CAST({N} AS BIGINT) FROM (SELECT DISTINCT lower(requested_server_name) AS value FROM flows "
        "WHERE application_name = 'DNS' AND requested_server_name IS NOT NULL)", base)
    q["indicator_additive_merge"] = with_flows(
        f"SELECT * FROM base UNION ALL SELECT 'domain_feed', 'threat_domains', value, CAST({N} AS BIGINT) FROM "
        "(SELECT value FROM hosts UNION SELECT value FROM names) n WHERE value NOT IN "
        "(SELECT value FROM base WHERE source = 'domain_feed')", base)
    ops = (f"ops AS (SELECT '+' || value AS op FROM hosts UNION ALL SELECT '-' || value FROM names WHERE ends_with(value, '.org') "
           f"UNION ALL SELECT value FROM names WHERE ends_with(value, '.xyz') UNION ALL SELECT v FROM ({fx.values_sql(fx.FEED_OPS, 'v')})), "
           "adds AS (SELECT DISTINCT substr(op, 2) AS value FROM ops WHERE starts_with(op, '+')), "
           "rems AS (SELECT DISTINCT substr(op, 2) AS value FROM ops WHERE starts_with(op, '-')), "
           "adds2 AS (SELECT value FROM adds WHERE value NOT IN (SELECT value FROM rems))")
    q["indicator_differential_merge"] = with_flows(
        "SELECT * FROM base WHERE source <> 'domain_feed' UNION ALL SELECT * FROM base WHERE source = 'domain_feed' "
        "AND value NOT IN (SELECT value FROM rems UNION SELECT value FROM adds2) UNION ALL "
        f"SELECT 'domain_feed', 'threat_domains', value, CAST({N} AS BIGINT) FROM adds2", base + ", " + ops)
    q["indicator_expiry"] = with_flows(
        f"SELECT * FROM base WHERE NOT (source = 'domain_feed' AND added_epoch < {N} - 24 * 3600)", base)
    q["indicator_category_view"] = with_flows(
        "SELECT DISTINCT b.category, b.value FROM base b JOIN feeds f USING (source) WHERE f.enabled", base)
    q["indicator_category_view_toggled"] = with_flows(
        "SELECT DISTINCT b.category, b.value FROM base b JOIN feeds f USING (source) WHERE "
        "(CASE WHEN source = 'url_feed' THEN true WHEN source = 'reputation_feed' THEN false ELSE f.enabled END)", base)
    q["indicator_category_counts"] = with_flows(
        "SELECT category, count(*) AS items FROM (SELECT DISTINCT b.category, b.value FROM base b JOIN feeds f "
        "USING (source) WHERE f.enabled) GROUP BY category", base)
    again = (f"SELECT 'domain_feed' AS source, 'threat_domains' AS category, value, CAST({N} AS BIGINT) AS added_epoch FROM names "
             "WHERE ends_with(value, '.xyz')")
    after = (f"SELECT * FROM base WHERE source <> 'domain_feed' UNION ALL {again} UNION ALL "
             f"SELECT 'host_feed', 'threat_domains', value, CAST({N} AS BIGINT) FROM hosts")
    q["indicator_add_source"] = with_flows(after, base)
    q["indicator_add_source_view"] = with_flows(
        f"SELECT DISTINCT category, value FROM ({after}) WHERE source NOT IN (SELECT source FROM feeds WHERE NOT enabled)", base)
    q["indicator_remove_source"] = with_flows("SELECT * FROM base WHERE source <> 'domain_feed'", base)
    q["indicator_source_counts"] = with_flows(
        "SELECT count(*) + 1 AS total_sources, count(*) FILTER (WHERE enabled AND source <> 'domain_feed') + 1 AS enabled_sources, "
        "count(*) FILTER (WHERE source <> 'url_feed') + 1 AS healthy_sources FROM feeds", base)
    versions = ("(SELECT source, count(*) AS n, md5(string_agg(value, '|' ORDER BY value)) AS h FROM {0} GROUP BY source) x JOIN "
                "(SELECT source, md5(string_agg(b || ':' || h, '|' ORDER BY b)) AS digest FROM (SELECT source, "
                "substr(md5(value), 1, 3) AS b, md5(string_agg(value, '|' ORDER BY value)) AS h FROM {0} GROUP BY source, b) "
                "GROUP BY source) y USING (source)")
    version = "n, '1.' || CAST(n AS VARCHAR) || '.' || substr(h, 1, 6) AS version, substr(h, 1, 8) AS hash, digest"
    distinct = "(SELECT DISTINCT source, value FROM base)"
    q["indicator_set_version"] = with_flows(f"SELECT source, {version} FROM {versions.format(distinct)}", base)
    q["indicator_snapshot_roundtrip"] = with_flows("SELECT * FROM base", base)
    replaced = ("SELECT * FROM base WHERE source = 'reputation_feed' UNION ALL "
                f"SELECT 'domain_feed', 'threat_domains', value, CAST({N} AS BIGINT) FROM hosts")
    q["indicator_snapshot_partition_overwrite"] = with_flows(replaced, base)
    # The feed state after its updates: an equal feed, a changed one, one that adds, one that fails.
    later = (f"{base}, later AS (SELECT source, category, value, added_epoch FROM base WHERE source = 'domain_feed' UNION ALL "
             f"SELECT 'reputation_feed', 'threat_ips', value, CAST({N} AS BIGINT) FROM (SELECT value FROM base WHERE source = "
             "'reputation_feed' AND ends_with(value, '1') UNION SELECT value FROM hosts) UNION ALL "
             "SELECT source, category, value, added_epoch FROM base WHERE source = 'url_feed' UNION ALL "
             f"SELECT 'url_feed', 'threat_urls', value, CAST({N} AS BIGINT) FROM names), "
             "stamped AS (SELECT source, category, value, CASE WHEN source = 'domain_feed' OR (source = 'url_feed' AND value NOT IN "
             f"(SELECT value FROM names)) THEN CAST({N} - 86400 AS BIGINT) ELSE added_epoch END AS added_epoch FROM later)")
    q["feed_state_items"] = with_flows("SELECT * FROM stamped", later)
    counts = ("(SELECT count(*) FROM base WHERE source = '{0}')")
    q["feed_state_versions"] = with_flows(
        f"SELECT source, category, {version}, changes, added, removed, health, error_message FROM {versions.format('stamped')} JOIN ("
        f"SELECT 'domain_feed' AS source, 'threat_domains' AS category, CAST(1 AS BIGINT) AS changes, {counts.format('domain_feed')} AS added, "
        "CAST(0 AS BIGINT) AS removed, 'degraded' AS health, 'HTTP 503' AS error_message UNION ALL "
        "SELECT 'reputation_feed', 'threat_ips', 2, (SELECT count(*) FROM stamped s WHERE source = 'reputation_feed' AND value NOT IN "
        "(SELECT value FROM base WHERE source = 'reputation_feed')), (SELECT count(*) FROM base WHERE source = 'reputation_feed' AND "
        "value NOT IN (SELECT value FROM stamped WHERE source = 'reputation_feed')), 'healthy', NULL UNION ALL "
        "SELECT 'url_feed', 'threat_urls', 2, (SELECT count(*) FROM names), 0, 'healthy', NULL) z USING (source)", later)
    cidr = (f"c AS (SELECT value AS cidr, trim(string_split(value, ';')[1]) AS t FROM ({fx.values_sql(fx.THREAT_CIDRS, 'value')})), "
            f"c2 AS (SELECT cidr, {ipv4_long_sql(chr(115) + 'plit_part(t, ' + chr(39) + '/' + chr(39) + ', 1)')} AS base, "
            "coalesce(TRY_CAST(NULLIF(split_part(t, '/', 2), '') AS INTEGER), 32) AS plen FROM c), "
            "c3 AS (SELECT cidr, base - (base % (CAST(1 AS BIGINT) << (32 - plen))) AS lo, "
            "base - (base % (CAST(1 AS BIGINT) << (32 - plen))) + (CAST(1 AS BIGINT) << (32 - plen)) - 1 AS hi "
            "FROM c2 WHERE base IS NOT NULL), "
            f"ends AS (SELECT 'src' AS role, src_ip AS ip FROM flows UNION ALL SELECT 'dst', dst_ip FROM flows), "
            f"ev AS (SELECT role, ip, {ipv4_long_sql('ip')} AS v FROM ends)")
    q["threat_cidr_matches"] = with_flows(
        "SELECT role, ip, cidr, count(*) AS flows FROM ev JOIN c3 ON ev.v BETWEEN c3.lo AND c3.hi "
        "GROUP BY role, ip, cidr", cidr)

    def norm(x: str) -> str:
        c = f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '#.*$', '')"
        sh = f"regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)"
        return f"regexp_replace(lower({sh}) || substr({c}, length({sh}) + 1), '/+$', '')"
    q["threat_url_matches"] = with_flows(
        f"SELECT page_id, url FROM pages WHERE {norm('url')} IN (SELECT {norm('url')} FROM pages WHERE {fx.THREAT_URL_RULE})")
    return q


# --- alert tables (U1, A10-A12) -------------------------------------------------------

def _alert_rows(q: dict[str, str]) -> list[tuple[str, str, int]]:
    """(engine, SQL of flat alert rows, priority) per detector, from the detector oracles."""
    def sel(engine, ttype, sev, conf, ioc, mitre, src):
        m = f"'{mitre}'" if mitre else "CAST(NULL AS VARCHAR)"
        return (f"SELECT '{engine}' AS engine_name, {ttype} AS threat_type, {sev} AS severity, "
                f"round(CAST({conf} AS DOUBLE), 6) AS confidence, {ioc} AS ioc, {m} AS mitre_technique "
                f"FROM ({q[src]})")
    dns, http, cov, beh = det.DNS_ENGINE, det.HTTP_ENGINE, det.COVERT_ENGINE, det.BEHAVIOR_ENGINE
    L = lambda s: f"'{s}'"
    ioc = "coalesce(dst_ip, '')"
    return [
        (dns, sel(dns, L("PHISHING"), L("HIGH"), 0.9, "domain || ',' || matched_threat_domain", None,
                  "detect_threat_domains"), 10),
        (dns, sel(dns, L("UNKNOWN_DOMAIN"), "severity", "ml_score", "domain", None, "detect_unknown_domains"), 10),
        (dns, sel(dns, L("DNS_TUNNEL"), L("HIGH"), 0.75, ioc, "T1071.004", "detect_dns_tunnel"), 10),
        (dns, sel(dns, L("DGA_DOMAIN"), L("HIGH"), 0.8, "domain", "T1583.001", "detect_dga_domains"), 10),
        (http, sel(http, L("HTTP_EXFILTRATION"), L("MEDIUM"), 0.5, ioc, None, "detect_http_exfiltration"), 20),
        (http, sel(http, L("UNCOMMON_PORT"), L("MEDIUM"), 0.6, "''", None, "detect_uncommon_ports"), 20),
        (http, sel(http, L("SUSPICIOUS_USER_AGENT"), L("MEDIUM"), 0.65, "''", None, "detect_suspicious_user_agents"), 20),
        (cov, sel(cov, L("ICMP_TUNNEL"), L("HIGH"), 0.7, ioc, None, "detect_icmp_tunnel"), 30),
        (cov, sel(cov, L("DNS_EXFILTRATION"), L("HIGH"), 0.65, ioc, None, "detect_dns_exfiltration"), 30),
        (cov, sel(cov, L("UNKNOWN_TLS"), L("MEDIUM"), 0.5, ioc, None, "detect_unknown_tls"), 30),
        (cov, sel(cov, L("C2_DATA_EXFIL"), L("HIGH"), 0.7, ioc, None, "detect_one_way_transfer"), 30),
        (beh, sel(beh, L("LARGE_DATA_TRANSFER"), L("MEDIUM"), 0.5, ioc, None, "detect_large_transfers"), 40),
        (beh, sel(beh, L("SUSPICIOUS_COMMUNICATION"), L("MEDIUM"), 0.55, ioc, None, "detect_suspicious_communication"), 40),
        (beh, sel(beh, L("PORT_SCAN"), L("HIGH"), 0.8, "coalesce(src_ip, '')", "T1046", "detect_port_scan"), 40),
    ]


PER_FLOW = {"HTTP_EXFILTRATION", "SUSPICIOUS_USER_AGENT", "ICMP_TUNNEL", "DNS_EXFILTRATION", "C2_DATA_EXFIL",
            "LARGE_DATA_TRANSFER", "SUSPICIOUS_COMMUNICATION"}


def alert_sql(q: dict[str, str]) -> dict[str, str]:
    rows = _alert_rows(q)
    union = " UNION ALL ".join(f"SELECT *, {p} AS priority FROM ({s})" for _, s, p in rows)
    per_flow = " UNION ALL ".join(f"SELECT * FROM ({s})" for _, s, p in rows if any(f"'{t}'" in s for t in PER_FLOW))
    out = {}
    out["alerts_all_detectors"] = f"SELECT * FROM ({union})"
    out["alerts_per_flow_fused"] = f"SELECT * FROM ({per_flow})"
    out["alerts_fused_scan"] = f"SELECT * FROM ({union})"
    out["alert_severity_counts"] = (f"SELECT count(*) FILTER (WHERE severity = 'HIGH') AS high_count, "
                                    f"count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_count, "
                                    f"count(*) FILTER (WHERE severity = 'LOW') AS low_count FROM ({union})")
    out["alert_counts_by_type"] = f"SELECT threat_type, count(*) AS alert_count FROM ({union}) GROUP BY threat_type"
    out["alert_counts_by_engine"] = (f"SELECT coalesce(engine_name, 'unknown') AS engine_name, count(*) AS alert_count "
                                     f"FROM ({union}) GROUP BY 1")
    out["alerts_isolated_run"] = out["alerts_all_detectors"]
    engines = " UNION ALL ".join(f"SELECT '{e}' AS name, {p} AS priority, (SELECT count(*) FROM ({union}) WHERE engine_name = '{e}') AS "
                                 "detections, 'healthy' AS health" for e, p in sorted({(e, p) for e, _, p in rows}))
    out["run_statistics"] = f"{engines} UNION ALL SELECT 'per_packet', 25, 0, 'error'"
    out["alert_bundle_by_type"] = (f"SELECT threat_type, count(*) AS alert_count, count(*) "
                                   f"AS bundled FROM ({union}) GROUP BY threat_type")
    return out


# --- flow metering (S2) ----------------------------------------------------------------

METER_IDLE_MS = 6 * 3600 * 1000
METER_ACTIVE_MS = 24 * 3600 * 1000


def metering_sql(idle: int = METER_IDLE_MS, active: int = METER_ACTIVE_MS, places: int = 6) -> str:
    key = "a_ip, a_port, b_ip, b_port, protocol"
    sfirst = "(src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port))"
    return (
        f"WITH p0 AS ({fx.packets_sql('duckdb')}), "
        f"p AS (SELECT *, {sfirst} AS a_to_b, CASE WHEN {sfirst} THEN src_ip ELSE dst_ip END AS a_ip, "
        f"CASE WHEN {sfirst} THEN src_port ELSE dst_port END AS a_port, CASE WHEN {sfirst} THEN dst_ip ELSE src_ip END AS b_ip, "
        f"CASE WHEN {sfirst} THEN dst_port ELSE src_port END AS b_port FROM p0 WHERE ts_ms IS NOT NULL), "
        f"q AS (SELECT *, lag(ts_ms) OVER (PARTITION BY {key} ORDER BY ts_ms, packet_id) AS prev_ts FROM p), "
        f"r AS (SELECT *, (prev_ts IS NULL OR ts_ms - prev_ts >= {idle}) AS is_start FROM q), "
        f"s AS (SELECT *, max(CASE WHEN is_start THEN ts_ms END) OVER (PARTITION BY {key} ORDER BY ts_ms, packet_id "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flow_start FROM r), "
        f"t AS (SELECT *, CAST(floor((ts_ms - flow_start) / {active}) AS BIGINT) AS piece, "
        f"floor((prev_ts - flow_start) / {active}) AS prev_piece FROM s), "
        f"u AS (SELECT *, CASE WHEN NOT is_start AND prev_piece = piece THEN ts_ms - prev_ts END AS piat FROM t), "
        f"g AS (SELECT {key}, flow_start, piece, first(a_to_b ORDER BY ts_ms, packet_id) AS ia, count(*) AS n, "
        f"sum(len) AS bytes, count(*) FILTER (WHERE a_to_b) AS ab_n, coalesce(sum(len) FILTER (WHERE a_to_b), 0) AS ab_b, "
        f"count(*) FILTER (WHERE NOT a_to_b) AS ba_n, coalesce(sum(len) FILTER (WHERE NOT a_to_b), 0) AS ba_b, "
        f"min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, avg(len) AS mean_ps, stddev_samp(len) AS std_ps, "
        f"avg(piat) AS mean_piat, stddev_samp(piat) AS std_piat FROM u GROUP BY {key}, flow_start, piece) "
        "SELECT CASE WHEN ia THEN a_ip ELSE b_ip END AS src_ip, CASE WHEN ia THEN b_ip ELSE a_ip END AS dst_ip, "
        "CASE WHEN ia THEN a_port ELSE b_port END AS src_port, CASE WHEN ia THEN b_port ELSE a_port END AS dst_port, "
        "protocol, n AS bidirectional_packets, CASE WHEN ia THEN ab_n ELSE ba_n END AS src2dst_packets, "
        "CASE WHEN ia THEN ba_n ELSE ab_n END AS dst2src_packets, CAST(bytes AS BIGINT) AS bidirectional_bytes, "
        "CAST(CASE WHEN ia THEN ab_b ELSE ba_b END AS BIGINT) AS src2dst_bytes, "
        "CAST(CASE WHEN ia THEN ba_b ELSE ab_b END AS BIGINT) AS dst2src_bytes, first_ms AS bidirectional_first_seen_ms, "
        "last_ms AS bidirectional_last_seen_ms, CAST(last_ms - first_ms AS DOUBLE) AS bidirectional_duration_ms, "
        f"round(mean_ps, {places}) AS bidirectional_mean_ps, round(coalesce(std_ps, 0.0), {places}) AS bidirectional_stddev_ps, "
        f"round(coalesce(mean_piat, 0.0), {places}) AS bidirectional_mean_piat_ms, "
        f"round(coalesce(std_piat, 0.0), {places}) AS bidirectional_stddev_piat_ms FROM g")


# --- streaming twins (T1, T2, T4, T6): the batch result of the same definition -----------

def streaming_sql(q: dict[str, str]) -> dict[str, str]:
    out = {}
    out["stream_per_flow_alerts"] = q["alerts_per_flow_fused"]
    ws = "CAST(floor(bidirectional_first_seen_ms / 300000) * 300000 AS BIGINT)"
    out["stream_dns_tunnel_windows"] = with_flows(
        f"SELECT {ws} AS window_start_ms, dst_ip, CAST(sum(bidirectional_packets) AS BIGINT) AS packet_count FROM flows "
        f"WHERE application_name = 'DNS' AND dst_ip IS NOT NULL GROUP BY 1, 2 "
        f"HAVING sum(bidirectional_packets) > {det.DNS_TUNNEL_PACKETS}")
    day = 86_400_000
    size, slide = 365 * day, 30 * day
    out["stream_port_scan_sliding"] = with_flows(
        f"SELECT *, ports > {det.SCAN_MIN_PORTS} AND targets < {det.SCAN_MAX_TARGETS} AS is_scan FROM (SELECT w AS window_start_ms, src_ip, "
        "count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS targets, CAST(sum(bidirectional_packets) AS BIGINT) AS packets FROM ("
        f"SELECT *, ts - ts % {slide} - k * {slide} AS w FROM (SELECT *, bidirectional_first_seen_ms AS ts FROM flows WHERE src_ip IS NOT NULL), "
        f"range(0, {size // slide + 1}) AS r(k)) WHERE w + {size} > ts AND w + {size} <= (SELECT max(bidirectional_first_seen_ms) - {day} "
        "FROM flows WHERE src_ip IS NOT NULL) GROUP BY w, src_ip)")
    out["stream_uncommon_port_windows"] = with_flows(
        f"SELECT {ws} AS window_start_ms, dst_port AS port, count(*) AS count FROM flows WHERE dst_port IS NOT NULL "
        f"AND dst_port NOT IN {_in(det.COMMON_PORTS)} GROUP BY 1, 2 HAVING count(*) > {det.UNCOMMON_PORT_FLOWS}")
    out["stream_unknown_tls_windows"] = with_flows(
        f"SELECT {ws} AS window_start_ms, dst_ip, count(*) AS flows FROM flows WHERE application_name = 'TLS' "
        f"AND application_confidence < {det.TLS_CONFIDENCE} AND dst_ip IS NOT NULL GROUP BY 1, 2 "
        f"HAVING count(*) >= {det.TLS_MIN_FLOWS}")
    key = "a_ip, a_port, b_ip, b_port, protocol"
    sfirst = "(src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port))"
    out["stream_packet_sessions"] = (
        f"WITH p0 AS ({fx.packets_sql('duckdb')}), "
        f"p AS (SELECT *, CASE WHEN {sfirst} THEN src_ip ELSE dst_ip END AS a_ip, "
        f"CASE WHEN {sfirst} THEN src_port ELSE dst_port END AS a_port, CASE WHEN {sfirst} THEN dst_ip ELSE src_ip END AS b_ip, "
        f"CASE WHEN {sfirst} THEN dst_port ELSE src_port END AS b_port FROM p0 WHERE ts_ms IS NOT NULL), "
        f"q AS (SELECT *, lag(ts_ms) OVER (PARTITION BY {key} ORDER BY ts_ms, packet_id) AS prev_ts FROM p), "
        f"r AS (SELECT *, sum(CASE WHEN prev_ts IS NULL OR ts_ms - prev_ts >= {METER_IDLE_MS} THEN 1 ELSE 0 END) OVER "
        f"(PARTITION BY {key} ORDER BY ts_ms, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM q) "
        f"SELECT {key}, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes, min(ts_ms) AS first_seen_ms, "
        f"max(ts_ms) AS last_seen_ms FROM r GROUP BY {key}, sid")
    out["stream_threat_domains"] = with_flows(
        "SELECT domain, matched_threat_domain FROM m",
        "dns AS (SELECT * FROM flows WHERE application_name = 'DNS'), "
        "names AS (SELECT DISTINCT requested_server_name AS domain FROM dns WHERE requested_server_name IS NOT NULL), "
        f"ind AS (SELECT DISTINCT rtrim(lower(value), '.') AS matched FROM ({fx.values_sql(fx.THREAT_DOMAINS, 'value')}) "
        "WHERE rtrim(lower(value), '.') <> ''), m AS (SELECT n.domain, arg_max(i.matched, length(i.matched)) AS "
        "matched_threat_domain FROM names n JOIN ind i ON rtrim(lower(n.domain), '.') = i.matched "
        "OR ends_with(rtrim(lower(n.domain), '.'), '.' || i.matched) GROUP BY n.domain)")
    return out


def surface_sql(q: dict[str, str]) -> dict[str, str]:
    rows = _alert_rows(q)
    union = " UNION ALL ".join(f"SELECT *, {p} AS priority FROM ({s})" for _, s, p in rows)
    out = {}
    out["dns_server_names"] = with_flows(
        "SELECT DISTINCT requested_server_name AS domain FROM flows WHERE application_name = 'DNS' "
        "AND requested_server_name IS NOT NULL")
    out["alerts_high_severity"] = f"SELECT * FROM ({union}) WHERE severity = 'HIGH'"
    out["alerts_first_100"] = (f"SELECT * FROM ({union}) ORDER BY priority, engine_name, threat_type, severity, "
                               f"confidence, ioc LIMIT 100")
    types = (f"SELECT threat_type FROM ({union}) UNION ALL SELECT 'PHISHING' FROM ({q['detect_domain_threats']}) "
             f"UNION ALL SELECT 'MALICIOUS_IP' FROM ({q['detect_malicious_ips']})")
    out["analysis_counts_by_type"] = f"SELECT threat_type, count(*) AS alert_count FROM ({types}) GROUP BY threat_type"
    return out
