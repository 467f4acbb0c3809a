"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables through the fixture bindings, so its
work grows with the data. Double columns are rounded to 6 places for the
oracle's value hash (the operators themselves return full precision).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.operators import detectors as det
from netsift.operators import flows as fl
from netsift.plans import oracle as orc
from netsift.sources.flows import Tables, load_tables

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def _q(fn: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(load_tables(spark, sf_dir)))
    run.__doc__ = fn.__doc__
    return run


def flow_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    cols = orc.FLOW_COLS
    q["filter_flows"] = _q(lambda t: fl.filter_flows(t.flows, **orc.FILTER).select(*cols))
    q["traffic_summary"] = _q(lambda t: fl.traffic_summary(t.flows))
    q["protocol_distribution"] = _q(lambda t: fl.protocol_distribution(t.flows))
    q["top_talkers"] = _q(lambda t: fl.top_talkers(t.flows))
    q["top_destinations"] = _q(lambda t: fl.top_destinations(t.flows))
    q["port_profile_summary"] = _q(lambda t: fl.port_profile(t.flows, orc.PORT)["summary"])
    q["port_profile_top_sources"] = _q(lambda t: fl.port_profile(t.flows, orc.PORT)["top_sources"])
    q["ip_profile_summary"] = _q(lambda t: fl.ip_profile(t.flows, orc.IP)["summary"])
    q["ip_profile_top_peers"] = _q(lambda t: fl.ip_profile(t.flows, orc.IP)["top_peers"])
    q["app_profile_summary"] = _q(lambda t: fl.app_profile(t.flows, orc.APP)["summary"])
    q["app_profile_top_talkers"] = _q(lambda t: fl.app_profile(t.flows, orc.APP)["top_talkers"])
    q["large_flows_summary"] = _q(lambda t: fl.large_flows(t.flows)["summary"])
    q["large_flows_top"] = _q(lambda t: fl.large_flows(t.flows)["top_flows"])
    q["explore_top_flows"] = _q(lambda t: fl.explore(t.flows, **orc.EXPLORE).select(*cols))
    q["top_flows_by_packets"] = _q(lambda t: fl.top_flows(t.flows, 50).select(*cols))
    return q


def detector_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["detect_threat_domains"] = _q(lambda t: det.threat_domains(t.flows, t.threat_domains))
    q["detect_unknown_domains"] = _q(lambda t: det.unknown_domains(t.flows))
    q["detect_dns_tunnel"] = _q(lambda t: det.dns_tunnel(t.flows))
    q["detect_dga_domains"] = _q(lambda t: det.dga_domains(t.flows))
    q["detect_http_exfiltration"] = _q(lambda t: det.http_exfiltration(t.flows))
    q["detect_uncommon_ports"] = _q(lambda t: det.uncommon_ports(t.flows))
    q["detect_suspicious_user_agents"] = _q(lambda t: det.suspicious_user_agents(t.flows))
    q["detect_icmp_tunnel"] = _q(lambda t: det.icmp_tunnel(t.flows))
    q["detect_dns_exfiltration"] = _q(lambda t: det.dns_exfiltration(t.flows))
    q["detect_unknown_tls"] = _q(lambda t: det.unknown_tls(t.flows))
    q["detect_one_way_transfer"] = _q(lambda t: det.one_way_transfer(t.flows))
    q["detect_large_transfers"] = _q(lambda t: det.large_transfers(t.flows))
    q["detect_suspicious_communication"] = _q(lambda t: det.suspicious_communication(t.flows))
    q["detect_port_scan"] = _q(lambda t: det.port_scan(t.flows))
    q["detect_plugin_port_scan"] = _q(lambda t: det.plugin_port_scan(t.flows))
    return q


def domain_queries() -> dict[str, Query]:
    from netsift.functions import domain as dom

    def names(t: Tables) -> DataFrame:
        return fl.distinct_names(t.flows).select(F.col("requested_server_name").alias("domain"))

    q: dict[str, Query] = {}
    q["domain_features"] = _q(lambda t: names(t).select("domain", dom.features("domain").alias("f"))
                              .select("domain", "f.*"))
    q["domain_rule_score"] = _q(lambda t: names(t).select(
        "domain", dom.rule_score("domain").alias("rule_score"), dom.rule_suspicious("domain").alias("is_suspicious")))
    return q


def anomaly_queries() -> dict[str, Query]:
    from netsift.operators import anomaly as an

    def scored(t: Tables) -> DataFrame:
        return an.score_flows(t.flows)

    q: dict[str, Query] = {}
    q["anomaly_scores"] = _q(lambda t: scored(t).select(
        "src_ip", "dst_ip", "dst_port", "bidirectional_bytes", "anomaly_score", "is_anomaly"))
    q["anomaly_summary"] = _q(lambda t: an.anomaly_summary(scored(t))["summary"])
    q["anomaly_top"] = _q(lambda t: an.anomaly_summary(scored(t))["top_anomalies"])

    def scaled(t: Tables) -> DataFrame:
        df, _ = an.standard_scale(t.flows, keep=["src_ip", "dst_ip"])
        return df.select("src_ip", "dst_ip", *[F.round(c, 4).alias(c) for c in an.ML_FEATURES])
    q["standard_scaled_features"] = _q(scaled)
    return q


def reputation_queries() -> dict[str, Query]:
    from netsift.operators import reputation as rp

    def cache(t: Tables) -> DataFrame:
        return rp.cache_from_snapshot(t.ip_reputation)

    def domain_lists(t: Tables) -> tuple[DataFrame, DataFrame]:
        """The whitelisted names and the safe list with its ages, from the reputation snapshot."""
        listed = F.col("judgment") == "Whitelist"
        rep = t.domain_reputation.withColumnRenamed("domain", "key")
        safe = rep.where(~listed & (F.col("severity") == "info")).select("key", (F.ascii("key") * 7 % 60).alias("age_days"))
        return rep.where(listed).select("key"), safe

    def external_keys(t: Tables) -> DataFrame:
        return t.flows.select(F.col("dst_ip").alias("key"))

    q: dict[str, Query] = {}
    q["reputation_cache_remove"] = _q(lambda t: rp.cache_remove(cache(t), external_keys(t)).select("key", "level", "age_days"))
    q["reputation_cache_remove_level"] = _q(lambda t: rp.cache_remove(cache(t), external_keys(t), "malicious")
                                            .select("key", "level", "age_days"))
    q["reputation_cache_clear_level"] = _q(lambda t: rp.cache_clear(cache(t), "safe").select("key", "level", "age_days"))
    q["ip_reputation_tiers"] = _q(lambda t: rp.ip_tiers(t.flows, cache(t)).select("ip", "tier", "abuse_score", "age_days"))
    q["ip_pending_lookups"] = _q(lambda t: rp.pending_ips(t.flows, cache(t)))
    q["detect_malicious_ips"] = _q(lambda t: rp.malicious_ips(t.flows, cache(t), t.ip_reputation))
    q["malicious_ip_listing"] = _q(lambda t: rp.malicious_ip_listing(t.flows, cache(t), t.ip_reputation))
    q["reputation_cache_get"] = _q(lambda t: rp.cache_get(
        cache(t), t.flows.select(F.col("dst_ip").alias("key"))).select("key", "level", "age_days"))
    q["reputation_cache_upsert"] = _q(lambda t: rp.cache_upsert(
        cache(t), rp.new_cache_entries(t.flows, cache(t), t.ip_reputation)).select("key", "level", "age_days", "abuse_score"))
    q["reputation_cache_expire"] = _q(lambda t: rp.cache_expire(cache(t))[1])
    q["reputation_cache_stats"] = _q(lambda t: rp.cache_stats(cache(t), t.flows.select(F.col("dst_ip").alias("key"))))
    q["ip_cache_hours_live"] = _q(lambda t: rp.hour_cache_live(cache(t), F.col("age_days") * 24).select("key", "level"))
    q["safe_list_days_left"] = _q(lambda t: rp.safe_days_left(cache(t)))
    q["reputation_lookup_stats"] = _q(lambda t: rp.lookup_stats(t.flows, cache(t), t.ip_reputation))
    q["domain_candidates"] = _q(lambda t: rp.candidate_domains(t.flows, det.unknown_domain_names(t.flows)))
    q["domain_gate"] = _q(lambda t: rp.gate_domains(rp.candidate_domains(t.flows, det.unknown_domain_names(t.flows))))
    q["domain_gate_lists"] = _q(lambda t: rp.gate_domains(
        rp.candidate_domains(t.flows, det.unknown_domain_names(t.flows)), *domain_lists(t)))
    q["domain_triage"] = _q(lambda t: rp.triage_domains(t.flows, t.domain_reputation,
                                                        flagged=det.unknown_domain_names(t.flows))
                            .select("domain", "severity", "judgment", "outcome"))
    q["detect_domain_threats"] = _q(lambda t: rp.domain_threats(t.flows, t.domain_reputation,
                                                                flagged=det.unknown_domain_names(t.flows)))
    return q


def graph_queries() -> dict[str, Query]:
    from netsift.operators import graph as gr
    from netsift.operators import reputation as rp
    from netsift.operators.alerts import union_alerts

    def threat_sets(t: Tables):
        rep = rp.cache_from_snapshot(t.ip_reputation)
        ips = rep.where(F.col("level") == "malicious").select(F.col("key").alias("value"))
        return ips, t.threat_domains

    def threat_graph(t: Tables):
        ips, doms = threat_sets(t)
        return gr.build_graph(t.flows, min_bytes=0, highlight_ips=ips, highlight_domains=doms)

    def some_alerts(t: Tables) -> DataFrame:
        return union_alerts([det.threat_domains_alerts(t.flows, t.threat_domains),
                             det.dns_tunnel_alerts(t.flows), det.port_scan_alerts(t.flows)])

    q: dict[str, Query] = {}
    q["graph_edges_full"] = _q(lambda t: gr.build_graph(t.flows)["edges"])
    q["graph_nodes_full"] = _q(lambda t: gr.build_graph(t.flows)["nodes"])
    q["graph_edges_threat"] = _q(lambda t: threat_graph(t)["edges"])
    q["graph_nodes_threat"] = _q(lambda t: threat_graph(t)["nodes"])
    q["graph_edges_anomaly"] = _q(lambda t: gr.anomaly_graph(t.flows, some_alerts(t))["edges"])
    q["graph_nodes_anomaly"] = _q(lambda t: gr.anomaly_graph(t.flows, some_alerts(t))["nodes"])
    q["alert_ioc_ips"] = _q(lambda t: gr.alert_iocs(some_alerts(t))["ips"])
    q["alert_ioc_domains"] = _q(lambda t: gr.alert_iocs(some_alerts(t))["domains"])
    return q


# --- indicators and feeds -------------------------------------------------------------

NOW_EPOCH = 1767225600  # fixed "now" of the indicator queries (2026-01-01T00:00:00Z)


def _stamp(hours) -> F.Column:
    return F.timestamp_seconds(F.lit(NOW_EPOCH) - hours.cast("bigint") * 3600)


def _page_hosts(t: Tables) -> DataFrame:
    h = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return t.urls.select(h.alias("value")).where(F.col("value") != "").distinct()


def _flow_names(t: Tables) -> DataFrame:
    return fl.distinct_names(t.flows).select(F.col("requested_server_name").alias("value"))


def base_indicators(t: Tables) -> DataFrame:
    from netsift.sources.builtin import builtin_indicators
    rep = (t.ip_reputation.where(F.col("abuse_score") >= 10)
           .select(F.lit("reputation_feed").alias("source"), F.lit("threat_ips").alias("category"),
                   F.col("ip").alias("value"), _stamp(F.col("age_days") * 24).alias("added_at")))
    names = _flow_names(t).select(F.lit("domain_feed").alias("source"), F.lit("threat_domains").alias("category"),
                                  "value", _stamp(F.length("value") % 48).alias("added_at"))
    urls = t.threat_urls.distinct().select(F.lit("url_feed").alias("source"), F.lit("threat_urls").alias("category"),
                                           "value", _stamp(F.length("value") % 72).alias("added_at"))
    built = builtin_indicators(t.spark).withColumn("added_at", _stamp(F.lit(0)))
    return rep.unionByName(names).unionByName(urls).unionByName(built)


def base_feeds(t: Tables) -> DataFrame:
    from netsift.operators.indicators import FEED_SCHEMA
    from netsift.sources.builtin import BUILTIN_SOURCES
    rows = [("reputation_feed", "threat_ips", "remote_url", True, "healthy", 0),
            ("domain_feed", "threat_domains", "remote_url", True, "healthy", 24),
            ("url_feed", "threat_urls", "remote_url", False, "degraded", 168)]
    rows += [(src, cat, "generated", True, "healthy", 0) for src, cat, _ in BUILTIN_SOURCES]
    return t.spark.createDataFrame(rows, FEED_SCHEMA)


def _out(ind: DataFrame) -> DataFrame:
    return ind.select("source", "category", "value", F.unix_seconds("added_at").alias("added_epoch"))


def indicator_queries() -> dict[str, Query]:
    from netsift.operators import indicators as ind
    from netsift.session import scratch_dir
    from netsift.sources import feeds as fd
    from netsift.sources import fixtures as fx
    from netsift.sources import sinks
    from netsift.sources.feed_state import FeedState
    from netsift.sources.builtin import BUILTIN_PHISHING_KEYWORDS, BUILTIN_SAFE_DOMAINS, BUILTIN_SUSPICIOUS_UA

    def now():
        return F.timestamp_seconds(F.lit(NOW_EPOCH))

    def header(t: Tables) -> DataFrame:
        return t.spark.createDataFrame([("# indicator feed",), ("",), ("   ",)], "line string")

    def text_feed(t: Tables, compression=None) -> DataFrame:
        lines = _flow_names(t).select(F.concat(F.lit("  "), "value", F.lit(" ")).alias("line"))
        path = sinks.write_lines(header(t).unionByName(lines), scratch_dir(t.spark, "feeds", "text"), compression)
        return fd.read_text_feed(t.spark, path)

    def hosts_feed(t: Tables) -> DataFrame:
        pairs = t.flows.where(F.col("requested_server_name").isNotNull()).select("dst_ip", "requested_server_name") \
            .distinct()
        lines = pairs.select(F.concat("dst_ip", F.lit("\t"), F.upper("requested_server_name"), F.lit(" #seen"))
                             .alias("line"))
        path = sinks.write_lines(header(t).unionByName(lines), scratch_dir(t.spark, "feeds", "hosts"))
        return fd.read_hosts_feed(t.spark, path)

    def csv_feed(t: Tables) -> DataFrame:
        rows = t.urls.select(F.col("page_id").alias("id"), "url", F.lit("online").alias("status"))
        path = sinks.write_csv(rows, scratch_dir(t.spark, "feeds", "csv"))
        return fd.read_csv_feed(t.spark, path, column=1, skip_header=True)

    def json_feed(t: Tables) -> DataFrame:
        path = sinks.write_json_documents(_flow_names(t), scratch_dir(t.spark, "feeds", "json"))
        return fd.read_json_feed(t.spark, path)

    def safe_items(t: Tables) -> DataFrame:
        parents = _page_hosts(t).where(F.size(F.split("value", r"\.")) >= 3) \
            .select(F.regexp_replace("value", r"^[^.]*\.", "").alias("value"))
        wl = t.domain_reputation.where(F.col("judgment") == "Whitelist").select(F.col("domain").alias("value"))
        built = t.literal(BUILTIN_SAFE_DOMAINS, "value")
        return built.unionByName(wl).unionByName(parents).distinct()

    def diff_ops(t: Tables) -> DataFrame:
        names = _flow_names(t)
        ops = (_page_hosts(t).select(F.concat(F.lit("+"), "value").alias("value"))
               .unionByName(names.where(F.col("value").endswith(".org")).select(F.concat(F.lit("-"), "value").alias("value")))
               .unionByName(names.where(F.col("value").endswith(".xyz")))
               .unionByName(t.literal(fx.FEED_OPS, "value")))
        return ops

    def updated_feeds(t: Tables):
        """Three sources are loaded; then one comes again unchanged and fails, one comes changed, one adds items."""
        base = base_indicators(t)
        state = FeedState(t.spark, scratch_dir(t.spark, "feed-state"))
        first = now() - F.expr("INTERVAL 1 DAY")
        for source, category in (("domain_feed", "threat_domains"), ("reputation_feed", "threat_ips"), ("url_feed", "threat_urls")):
            state.apply_update(source, category, base.where(F.col("source") == source), first)
        state.apply_update("domain_feed", "threat_domains", _flow_names(t).unionByName(_flow_names(t)), now())
        state.record_failure("domain_feed", "HTTP 503", now())
        some = base.where((F.col("source") == "reputation_feed") & F.col("value").endswith("1")).select("value")
        state.apply_update("reputation_feed", "threat_ips", some.unionByName(_page_hosts(t)), now())
        state.apply_update("url_feed", "threat_urls", _flow_names(t), now(), incremental=True)
        return FeedState(t.spark, state.root)  # as a later run finds it

    def added(t: Tables) -> tuple[DataFrame, DataFrame]:
        """A source of page hosts is added, and domain_feed again with other items."""
        feeds, items = ind.add_source(base_feeds(t), base_indicators(t), "host_feed", "threat_domains", _page_hosts(t), now=now())
        return ind.add_source(feeds, items, "domain_feed", "threat_domains",
                              _flow_names(t).where(F.col("value").endswith(".xyz")), now=now())

    q: dict[str, Query] = {}
    q["feed_text_items"] = _q(lambda t: text_feed(t))
    q["feed_gzip_items"] = _q(lambda t: text_feed(t, "gzip"))
    q["feed_hosts_items"] = _q(hosts_feed)
    q["feed_csv_items"] = _q(csv_feed)
    q["feed_json_items"] = _q(json_feed)
    q["safe_domain_lookup"] = _q(lambda t: ind.safe_domain_lookup(
        _flow_names(t).unionByName(_page_hosts(t)).distinct(), "value", safe_items(t)))
    q["whitelist_ip_prefix_lookup"] = _q(lambda t: ind.prefix_lookup(
        t.flows.select(F.col("src_ip").alias("value")).distinct(), "value", t.literal(WHITELIST_IP_PREFIXES, "value")))
    q["ua_keyword_lookup"] = _q(lambda t: ind.substring_lookup(
        t.flows.where(F.col("user_agent").isNotNull()).select(F.col("user_agent").alias("value"))
        .unionByName(t.urls.select(F.col("url").alias("value"))).distinct(), "value",
        t.literal(BUILTIN_SUSPICIOUS_UA + BUILTIN_PHISHING_KEYWORDS, "value"))
        .select("value", F.array_join("matched", ",").alias("matched")))
    q["exact_indicator_lookup"] = _q(lambda t: ind.exact_lookup(
        t.flows, "dst_ip", ind.category_view(base_indicators(t), base_feeds(t), "threat_ips"))
        .groupBy("dst_ip").agg(F.count(F.lit(1)).alias("flows")))
    q["indicator_snapshot_replace"] = _q(lambda t: _out(ind.snapshot_replace(
        base_indicators(t), "domain_feed", "threat_domains",
        det.dns_flows(t.flows).where(F.col("requested_server_name").isNotNull())
        .select(F.lower("requested_server_name").alias("value")), now())))
    q["indicator_additive_merge"] = _q(lambda t: _out(ind.additive_merge(
        base_indicators(t), "domain_feed", "threat_domains", _page_hosts(t).unionByName(_flow_names(t)), now())))
    q["indicator_differential_merge"] = _q(lambda t: _out(ind.differential_merge(
        base_indicators(t), "domain_feed", "threat_domains", diff_ops(t), now())))
    q["indicator_expiry"] = _q(lambda t: _out(ind.expire(base_indicators(t), "domain_feed", 24, now())))
    q["indicator_category_view"] = _q(lambda t: ind.category_view(base_indicators(t), base_feeds(t)))
    q["indicator_category_view_toggled"] = _q(lambda t: ind.category_view(
        base_indicators(t), ind.set_enabled(ind.set_enabled(base_feeds(t), "url_feed", True),
                                            "reputation_feed", False)))
    q["indicator_category_counts"] = _q(lambda t: ind.category_counts(base_indicators(t), base_feeds(t)))
    q["indicator_source_counts"] = _q(lambda t: ind.source_counts(ind.set_enabled(added(t)[0], "domain_feed", False)))
    q["indicator_add_source"] = _q(lambda t: _out(added(t)[1]))
    q["indicator_add_source_view"] = _q(lambda t: ind.category_view(added(t)[1], added(t)[0]))
    q["indicator_remove_source"] = _q(lambda t: _out(ind.remove_source(base_feeds(t), base_indicators(t), "domain_feed")[1]))
    q["indicator_set_version"] = _q(lambda t: ind.set_version(base_indicators(t), by=["source"]))
    q["feed_state_versions"] = _q(lambda t: updated_feeds(t).state().drop("generations", "updated_at"))
    q["feed_state_items"] = _q(lambda t: _out(updated_feeds(t).items()))
    q["threat_cidr_matches"] = _q(lambda t: ind.threat_ip_matches(t.flows, t.threat_cidrs))
    q["threat_url_matches"] = _q(lambda t: ind.threat_url_matches(t.urls, t.threat_urls))
    return q


# --- fixed values: IP prefixes of the whitelist lookup query ---------------------------
WHITELIST_IP_PREFIXES = ["10.0.0.1", "172.16.", "203.0.113.", "10.66."]


# --- alert tables (U1, A10-A12, X3) ------------------------------------------------------

def alert_queries() -> dict[str, Query]:
    from netsift.operators import alerts as al
    from netsift.operators import fused
    from netsift.plans.registry import Context, Detector, default_registry, read_run, run_reports
    from netsift.session import scratch_dir

    def per_packet(flows: DataFrame, ctx: Context, cfg: dict) -> DataFrame:
        """A detector that divides by zero in its tasks, whatever the session's ANSI setting."""
        none = F.col("bidirectional_packets") - F.col("bidirectional_packets")
        rate = F.when(none == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(F.col("bidirectional_bytes"))
        return al.to_alerts(flows.where(rate > 0), engine="per_packet", threat_type="RATE", severity="LOW", confidence=0.5,
                            description=F.concat(F.lit("rate "), rate.cast("string")), evidence={"rate": rate}, ioc=[F.col("dst_ip")])

    def isolated(t: Tables) -> str:
        """The four engines and one that fails in its tasks, alerts committed under a fresh folder."""
        registry = default_registry()
        registry.register(Detector("per_packet", per_packet, priority=25))
        path = scratch_dir(t.spark, "run")
        registry.commit_all(t.flows, Context(t.spark, threat_domains=t.threat_domains), path)
        return path

    def all_alerts(t: Tables, fused_scan: bool = True) -> DataFrame:
        ctx = Context(t.spark, threat_domains=t.threat_domains)
        alerts, _ = default_registry(fused_scan=fused_scan).run_all(t.flows, ctx)
        return alerts

    def flat(a: DataFrame) -> DataFrame:
        return al.ioc_string(a)

    q: dict[str, Query] = {}
    q["alerts_all_detectors"] = _q(lambda t: flat(all_alerts(t, fused_scan=False)))
    q["alerts_fused_scan"] = _q(lambda t: flat(all_alerts(t, fused_scan=True)))
    q["alerts_per_flow_fused"] = _q(lambda t: flat(fused.per_flow_alerts(t.flows)))
    q["alert_severity_counts"] = _q(lambda t: al.severity_counts(all_alerts(t)))
    q["alert_counts_by_type"] = _q(lambda t: al.counts_by(all_alerts(t), "threat_type"))
    q["alert_counts_by_engine"] = _q(lambda t: al.counts_by(all_alerts(t), "engine_name"))
    q["alerts_isolated_run"] = _q(lambda t: flat(read_run(t.spark, isolated(t))))
    q["run_statistics"] = _q(lambda t: run_reports(t.spark, isolated(t)).select("name", "priority", "detections", "health"))
    q["alert_bundle_by_type"] = _q(lambda t: al.alert_bundle(all_alerts(t)).groupBy("threat_type").agg(
        F.count(F.lit(1)).alias("alert_count"), F.count("description").alias("bundled")))
    return q


# --- flow metering (S2) -------------------------------------------------------------------

def metering_queries() -> dict[str, Query]:
    from netsift.operators import metering as mt
    from netsift.plans.oracle import METER_ACTIVE_MS, METER_IDLE_MS

    q: dict[str, Query] = {}
    q["flow_metering"] = _q(lambda t: mt.meter(t.packets, METER_IDLE_MS, METER_ACTIVE_MS)
                            .select(*mt.METERED_COLUMNS))
    q["flow_metering_fine_buckets"] = _q(lambda t: mt.meter(t.packets, METER_IDLE_MS, METER_ACTIVE_MS,
                                                            bucket_ms=600_000).select(*mt.METERED_COLUMNS))
    return q


# --- learned operators (M4/M5, M8-M10) — rows-only checks -----------------------------------

def ml_queries() -> dict[str, Query]:
    from netsift.functions import domain as dom
    from netsift.operators import domain_model as dm
    from netsift.operators import iforest as ifo

    def forest(t: Tables):
        return ifo.fit(t.flows)

    def parts(t: Tables) -> DataFrame:
        train, test = dm.split(dm.labelled_domains(t.flows))
        return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))

    def rule_evaluation(t: Tables) -> DataFrame:
        """M9 over the rule scores of all names."""
        scores = dom.rule_score("domain")
        rated = dm.labelled_domains(t.flows).select("label", scores.alias("score"))
        return dm.area_under_curve(rated).select("positives", "negatives", F.round("auc", 9).alias("auc"))

    def evaluation(t: Tables) -> DataFrame:
        model, test, _ = gbt(t)
        e = dm.evaluate(model, test)
        top = F.lit(", ".join(name for name, _ in e.importances))
        return e.summary.select("*", F.lit(e.auc).alias("auc"), top.alias("top_features"))

    def gbt(t: Tables):
        labelled = dm.labelled_domains(t.flows)
        train, test = dm.split(labelled)
        return dm.train(train), test, labelled

    def scores(t: Tables) -> DataFrame:
        model, _, labelled = gbt(t)
        return dm.score(model, labelled)

    q: dict[str, Query] = {}
    q["isolation_forest_scores"] = _q(lambda t: ifo.predict(t.flows, forest(t)).select(
        "src_ip", "dst_ip", "dst_port", "bidirectional_bytes", "anomaly_score", "is_anomaly"))
    q["domain_model_split"] = _q(lambda t: parts(t))
    q["domain_rule_evaluation"] = _q(lambda t: rule_evaluation(t))
    q["domain_model_evaluation"] = _q(lambda t: evaluation(t))
    q["domain_model_scores"] = _q(scores)
    q["domain_model_confusion"] = _q(lambda t: dm.evaluate(*gbt(t)[:2]).confusion)
    q["detect_unknown_domains_model"] = _q(lambda t: det.unknown_domains(t.flows, scores(t)))
    return q


# --- streaming (S3, T1-T6): drained with availableNow, compared with the batch result ------

def streaming_queries() -> dict[str, Query]:
    from netsift.operators import alerts as al
    from netsift.operators import metering as mt
    from netsift.session import scratch_dir
    from netsift.sources.flows import read_flow_stream
    from netsift.streaming import detectors as sd

    def land(t: Tables, df: DataFrame, name: str) -> str:
        path = scratch_dir(t.spark, "stream", name)
        df.write.mode("overwrite").parquet(path)
        return path

    def flow_stream(t: Tables) -> DataFrame:
        return read_flow_stream(t.spark, land(t, t.flows, "flows_in"))

    def dirs(t: Tables, name: str) -> tuple[str, str]:
        base = scratch_dir(t.spark, "stream", name)
        return f"{base}/out", f"{base}/checkpoint"

    def per_flow(t: Tables) -> DataFrame:
        out, ck = dirs(t, "t1")
        sd.run_append(sd.stateless_alerts(flow_stream(t)), out, ck)
        return al.ioc_string(t.spark.read.parquet(out))

    def upsert(t: Tables, name: str, build, key: list[str], schema: str) -> DataFrame:
        out, ck = dirs(t, name)
        sd.run_upsert(build(flow_stream(t)), out, ck)
        return sd.read_latest(t.spark, out, key, schema)

    def sessions(t: Tables) -> DataFrame:
        from netsift.schema import PACKET_SCHEMA
        path = land(t, t.packets, "packets_in")
        out, ck = dirs(t, "t4")
        gap_ms, wm_ms = METER_IDLE_S * 1000, 3600 * 1000

        def drain():
            s = t.spark.readStream.schema(PACKET_SCHEMA).parquet(path)
            sd.run_append(sd.packet_sessions(s, gap=f"{METER_IDLE_S} seconds", watermark="1 hour"), out, ck)
        drain()
        max_ts = t.spark.read.parquet(path).agg(F.max("ts_ms")).first()[0] or 0
        sd.flush_sessions(t.spark, path, max_ts, gap_ms, wm_ms)
        drain()
        return t.spark.read.parquet(out).where(F.col("a_ip") != sd.HEARTBEAT_IP)

    def scans(t: Tables) -> DataFrame:
        out, ck = dirs(t, "t3")
        used = t.flows.select("src_ip", "dst_ip", "dst_port", "bidirectional_packets", "bidirectional_first_seen_ms")
        flows = read_flow_stream(t.spark, land(t, used, "scan_flows_in"))
        sd.run_append(sd.exact_port_scan(flows, window="365 days", slide="30 days", watermark="1 day"), out, ck)
        return t.spark.read.parquet(out)

    def threat_hits(t: Tables) -> DataFrame:
        out, ck = dirs(t, "t6")
        doms = t.threat_domains
        sd.static_join_each_batch(flow_stream(t), lambda s: doms, sd.threat_domain_hits, out, ck)
        return t.spark.read.parquet(out).select("domain", "matched_threat_domain").distinct()

    def stateful_metering(t: Tables) -> DataFrame:
        import time as _time

        from netsift.schema import PACKET_SCHEMA
        from netsift.plans.oracle import METER_ACTIVE_MS, METER_IDLE_MS
        landing = scratch_dir(t.spark, "stream", "packets_ordered")
        pk = t.packets
        lo, hi = pk.agg(F.min("ts_ms"), F.max("ts_ms")).first()
        chunks = 4
        step = (hi - lo) // chunks + 1 if lo is not None else 1
        for i in range(chunks if lo is not None else 0):   # land in time order, one file per chunk
            (pk.where((F.col("ts_ms") >= lo + i * step) & (F.col("ts_ms") < lo + (i + 1) * step))
             .coalesce(1).write.mode("append").parquet(landing))
            _time.sleep(1.1)
        out, ck = dirs(t, "t4b")

        def drain():
            s = t.spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", 1).parquet(landing)
            sd.run_append(sd.stateful_metering(s, METER_IDLE_MS, METER_ACTIVE_MS), out, ck)
        drain()
        sd.flush_sessions(t.spark, landing, hi or 0, METER_IDLE_MS, 3600 * 1000)
        drain()
        res = t.spark.read.parquet(out).where(F.col("src_ip") != sd.HEARTBEAT_IP)
        stats = ["bidirectional_mean_ps", "bidirectional_stddev_ps", "bidirectional_mean_piat_ms",
                 "bidirectional_stddev_piat_ms"]
        return res.select(*[F.round(c, 1).alias(c) if c in stats else F.col(c) for c in res.columns])

    q: dict[str, Query] = {}
    q["stream_per_flow_alerts"] = _q(per_flow)
    q["stream_flow_metering"] = _q(stateful_metering)
    q["stream_dns_tunnel_windows"] = _q(lambda t: upsert(
        t, "t2a", sd.tumbling_dns_tunnel, ["window_start_ms", "dst_ip"],
        "window_start_ms long, dst_ip string, packet_count long"))
    q["stream_uncommon_port_windows"] = _q(lambda t: upsert(
        t, "t2b", sd.tumbling_uncommon_ports, ["window_start_ms", "port"],
        "window_start_ms long, port int, count long"))
    q["stream_unknown_tls_windows"] = _q(lambda t: upsert(
        t, "t2c", sd.tumbling_unknown_tls, ["window_start_ms", "dst_ip"],
        "window_start_ms long, dst_ip string, flows long"))
    # flow start times in the test data are whole days, so the sliding window is sized in days
    q["stream_port_scan_sliding"] = _q(lambda t: scans(t).withColumn("is_scan", sd.is_scan()))
    q["stream_packet_sessions"] = _q(sessions)
    q["stream_threat_domains"] = _q(threat_hits)
    return q


METER_IDLE_S = 6 * 3600


# --- remaining surface: P2/P3, P12, W5, S11, S12, X6 --------------------------------------

def surface_queries() -> dict[str, Query]:
    from netsift.operators import alerts as al
    from netsift.operators import reputation as rp
    from netsift.plans.analysis import analyze
    from netsift.plans.registry import Context, default_registry
    from netsift.session import scratch_dir
    from netsift.sources import sinks

    def all_alerts(t: Tables) -> DataFrame:
        alerts, _ = default_registry().run_all(t.flows, Context(t.spark, threat_domains=t.threat_domains))
        return alerts

    def report(t: Tables) -> DataFrame:
        path = scratch_dir(t.spark, "report")
        summary = fl.traffic_summary(t.flows)
        cache = rp.cache_from_snapshot(t.ip_reputation)
        sinks.write_result_json(path, summary, all_alerts(t), rp.malicious_ip_listing(t.flows, cache, t.ip_reputation))
        return t.spark.read.json(f"{path}/findings").select("type", "severity", "description")

    def snapshot(t: Tables) -> DataFrame:
        """The items of every source, as read back."""
        path = scratch_dir(t.spark, "indicators")
        sinks.write_indicators(base_indicators(t), path)
        return _out(sinks.read_indicators(t.spark, path))

    def overwrite(t: Tables) -> DataFrame:
        path = sinks.write_indicators(base_indicators(t), scratch_dir(t.spark, "indicators"))
        new = _page_hosts(t).select(F.lit("domain_feed").alias("source"), F.lit("threat_domains").alias("category"), "value",
                                    _stamp(F.lit(0)).alias("added_at"))
        sinks.write_indicators(new, path, sources=["domain_feed"])
        return _out(sinks.read_indicators(t.spark, path, ["domain_feed", "reputation_feed"]))

    def analysis(t: Tables) -> DataFrame:
        res = analyze(t.flows, Context(t.spark, threat_domains=t.threat_domains),
                      domain_reputation=t.domain_reputation, ip_cache=rp.cache_from_snapshot(t.ip_reputation),
                      ip_service=t.ip_reputation)
        return res["type_counts"]

    first_order = ["priority", "engine_name", "threat_type", "severity", "confidence", "ioc"]
    q: dict[str, Query] = {}
    q["dns_server_names"] = _q(lambda t: fl.distinct_names(fl.application_subset(t.flows, ["DNS"]))
                               .select(F.col("requested_server_name").alias("domain")))
    q["alerts_high_severity"] = _q(lambda t: al.ioc_string(al.select_alerts(all_alerts(t), severity="HIGH")))
    q["alerts_first_100"] = _q(lambda t: al.ioc_string(all_alerts(t)).orderBy(*first_order).limit(100))
    q["report_findings"] = _q(report)
    q["indicator_snapshot_roundtrip"] = _q(snapshot)
    q["indicator_snapshot_partition_overwrite"] = _q(overwrite)
    q["analysis_counts_by_type"] = _q(analysis)
    return q


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q.update(flow_queries())
    q.update(detector_queries())
    q.update(domain_queries())
    q.update(anomaly_queries())
    q.update(reputation_queries())
    q.update(graph_queries())
    q.update(indicator_queries())
    q.update(alert_queries())
    q.update(metering_queries())
    q.update(ml_queries())
    q.update(streaming_queries())
    q.update(surface_queries())
    return q
