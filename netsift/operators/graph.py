"""Communication graph: edges (A14, G1, G3), highlight filter (J10, G2),
nodes (J11, G4) and IOC extraction from alerts (G5).

The edge table is one aggregate keyed by (src, dst). Server names are not
collected per edge: highlight matching joins the distinct (src, dst, name)
table with the domain set by label suffix (equi-join), so a hot edge with
millions of names is still spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions import domain as dom
from netsift.functions import ip as ipf
from netsift.session import scratch_dir

# --- fixed values -------------------------------------------------------------
DEFAULT_MIN_BYTES = 1000
LABEL_CHARS = 30
LABEL_SHOW_BYTES = 100_000
DOMAIN_NODE_SIZE = 40
IP_TEXT_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
DOMAIN_TEXT_PATTERN = r"\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}\b"
DOMAIN_EDGE_LABEL = "domain access"
# ------------------------------------------------------------------------------


def link_width(value: Column) -> Column:
    """min(bytes / 1e6 + 1, 6)."""
    return F.least(value / 1e6 + 1.0, F.lit(6.0))


def node_size(traffic: Column) -> Column:
    """min(max(traffic ** 0.35, 15), 70)."""
    return F.least(F.greatest(F.pow(traffic.cast("double"), 0.35), F.lit(15.0)), F.lit(70.0))


def clean_flows(flows: DataFrame) -> DataFrame:
    """P7 on both endpoints."""
    return flows.where(ipf.is_graph_valid_ip("src_ip") & ipf.is_graph_valid_ip("dst_ip"))


def edge_table(flows: DataFrame) -> DataFrame:
    """A14 + P7: per (src, dst): summed bytes and the sorted distinct
    application names joined with ', ' and cut to 30 characters; only edges
    whose two endpoints pass P7.

    P7 depends on the endpoints only, so "filter flows, then aggregate"
    equals "aggregate, then filter edges": the predicate runs once per
    distinct edge, after the partial/final aggregate. It is tied to the
    aggregate's count so Catalyst cannot push it back below the shuffle.
    """
    app = F.col("application_name")
    agg = flows.groupBy(F.col("src_ip").alias("source"), F.col("dst_ip").alias("target")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.sum("bidirectional_bytes"), F.lit(0)).cast("bigint").alias("value"),
        F.substring(F.array_join(F.array_sort(F.collect_set(F.when(app != "", app))), ", "), 1, LABEL_CHARS)
        .alias("label"))
    valid = F.when(F.col("_n") > 0, ipf.is_graph_valid_ip("source") & ipf.is_graph_valid_ip("target")) \
        .otherwise(F.lit(False))
    return agg.where(valid).drop("_n")


def edge_names(flows: DataFrame) -> DataFrame:
    """Distinct lower-cased server names per edge (joined with valid edges later)."""
    n = F.lower(F.col("requested_server_name"))
    return (flows.where(F.col("requested_server_name").isNotNull() & (F.col("requested_server_name") != ""))
            .select(F.col("src_ip").alias("source"), F.col("dst_ip").alias("target"), n.alias("sni")).distinct())


def _domain_matches(flows: DataFrame, domains: DataFrame) -> DataFrame:
    """(source, target, domain): an edge name equals the domain or ends with '.' + domain."""
    d = domains.select(F.lower(F.col("value")).alias("domain")).where(F.col("domain") != "").distinct()
    names = edge_names(flows)
    sfx = names.select("source", "target", "sni", F.explode(dom.suffixes("sni")).alias("domain"))
    hit = sfx.join(d, "domain")
    longest = hit.groupBy("source", "target", "sni").agg(F.max_by("domain", F.length("domain")).alias("domain"))
    return longest.select("source", "target", "domain")  # one row per matched name of the edge


def build_graph(flows: DataFrame, min_bytes: int = DEFAULT_MIN_BYTES, highlight_ips: DataFrame | None = None,
                highlight_domains: DataFrame | None = None) -> dict[str, DataFrame]:
    """``{"edges", "nodes"}``.

    Without highlight sets: every edge with value >= ``min_bytes`` (G1).
    With them (G2): only edges touching a highlighted IP or carrying a name
    under a highlighted domain, no byte floor (two empty sets give every
    valid edge); matched names add an
    IP → domain edge (G3); bad actors become "Threat Node"s (G4).
    ``highlight_*`` are one-column DataFrames ``value``.
    """
    valid_edges = edge_table(flows)
    edges = valid_edges
    highlighted = highlight_ips is not None or highlight_domains is not None
    if not highlighted:
        if min_bytes > 0:
            edges = edges.where(F.col("value") >= min_bytes)
        ip_edges = edges.select("source", "target", "value", "label", F.lit(False).alias("is_highlighted"))
        dom_edges = None
        bad = None
    else:
        flag = F.lit(False)
        e = edges
        if highlight_ips is not None:
            ips = highlight_ips.select(F.col("value").alias("ip")).distinct()
            e = (e.join(ips.withColumnRenamed("ip", "source").withColumn("_s", F.lit(True)), "source", "left")
                 .join(ips.withColumnRenamed("ip", "target").withColumn("_t", F.lit(True)), "target", "left"))
            flag = flag | F.coalesce(F.col("_s"), F.lit(False)) | F.coalesce(F.col("_t"), F.lit(False))
        matches = None
        if highlight_domains is not None:
            matches = _domain_matches(flows, highlight_domains)
            hit_edges = matches.select("source", "target").distinct().withColumn("_d", F.lit(True))
            e = e.join(hit_edges, ["source", "target"], "left")
            flag = flag | F.coalesce(F.col("_d"), F.lit(False))
        given = [h.select(F.col("value").cast("string").alias("value")) for h in (highlight_ips, highlight_domains) if h is not None]
        none_given = reduce(DataFrame.unionAll, given).agg(F.count(F.lit(1)) == 0).scalar()
        e = e.withColumn("is_highlighted", flag).where(F.col("is_highlighted") | none_given)
        ip_edges = e.select("source", "target", "value", "label", "is_highlighted")
        dom_edges = None
        bad = None
        if matches is not None:
            dom_edges = (matches.join(edges.select("source", "target", "value"), ["source", "target"])
                         .select("source", F.col("domain").alias("target"), "value",
                                 F.lit(DOMAIN_EDGE_LABEL).alias("label"), F.lit(True).alias("is_highlighted")))
            bad = dom_edges.select(F.col("source").alias("id")).distinct()
        if highlight_ips is not None:
            b = highlight_ips.select(F.col("value").alias("id")).distinct()
            bad = b if bad is None else bad.unionByName(b).distinct()
    all_edges = ip_edges.withColumn("kind", F.lit("ip"))
    if dom_edges is not None:
        all_edges = all_edges.unionByName(dom_edges.withColumn("kind", F.lit("domain")))
    all_edges = all_edges.withColumn("width", F.when(F.col("kind") == "ip", link_width(F.col("value")))
                                     .otherwise(F.lit(3.0)))
    nodes = build_nodes(valid_edges, ip_edges, dom_edges, bad)
    return {"edges": all_edges, "nodes": nodes}


def node_traffic(edges: DataFrame) -> DataFrame:
    """Bytes as source, bytes as destination (over P7-valid flows, i.e.
    valid edges), traffic = max of the two; missing side → 0."""
    s = edges.groupBy(F.col("source").alias("id")).agg(F.sum("value").alias("as_src"))
    d = edges.groupBy(F.col("target").alias("id")).agg(F.sum("value").alias("as_dst"))
    return (s.join(d, "id", "full")
            .select("id", F.greatest(F.coalesce("as_src", F.lit(0)), F.coalesce("as_dst", F.lit(0)))
                    .cast("bigint").alias("traffic")))


def build_nodes(edges: DataFrame, ip_edges: DataFrame, dom_edges: DataFrame | None,
                bad: DataFrame | None) -> DataFrame:
    """IP nodes (traffic, P8 category, threat flag, size, label) and domain nodes."""
    ids = ip_edges.select(F.col("source").alias("id")).unionByName(ip_edges.select(F.col("target").alias("id"))) \
        .distinct()
    n = ids.join(node_traffic(edges), "id", "left").withColumn("traffic", F.coalesce("traffic", F.lit(0)))
    if bad is not None:
        n = n.join(bad.withColumn("_bad", F.lit(True)), "id", "left")
        is_bad = F.coalesce(F.col("_bad"), F.lit(False))
    else:
        is_bad = F.lit(False)
    ip_nodes = n.select(
        "id", F.lit("ip").alias("type"),
        F.when(is_bad, "Threat Node").otherwise(ipf.ip_category(F.col("id"))).alias("category"),
        F.col("traffic").alias("value"), node_size(F.col("traffic")).alias("size"),
        ((F.col("traffic") > LABEL_SHOW_BYTES) | is_bad).alias("show_label"), is_bad.alias("is_bad_actor"))
    if dom_edges is None:
        return ip_nodes
    dn = dom_edges.select(F.col("target").alias("id")).distinct().select(
        "id", F.lit("domain").alias("type"), F.lit("Domain").alias("category"), F.lit(0).cast("bigint").alias("value"),
        F.lit(float(DOMAIN_NODE_SIZE)).alias("size"), F.lit(True).alias("show_label"),
        F.lit(False).alias("is_bad_actor"))
    return ip_nodes.unionByName(dn)


# --- G5: IOC extraction from alerts ----------------------------------------------

def _valid_domain(s: Column) -> Column:
    t = F.lower(F.trim(s))
    looks_ip = t.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}\b") & (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))) == 3)
    return (t != "") & (F.instr(t, ".") > 0) & ~t.endswith(".") & ~looks_ip


def alert_iocs(alerts: DataFrame) -> dict[str, DataFrame]:
    """IPs and domains mentioned by alerts (evidence values, the evidence
    ``domain`` entry, description text and the IOC list). Returns
    ``{"ips": (value), "domains": (value)}``, distinct."""
    texts = alerts.select(F.explode(F.array_union(F.coalesce(F.map_values("evidence"), F.array().cast("array<string>")),
                                                  F.array(F.col("description")))).alias("t")) \
        .where(F.col("t").isNotNull())
    ip_text = texts.select(F.explode(F.regexp_extract_all("t", F.lit(IP_TEXT_PATTERN), 0)).alias("value"))
    dom_text = texts.select(F.explode(F.regexp_extract_all("t", F.lit(DOMAIN_TEXT_PATTERN), 0)).alias("d")) \
        .where(_valid_domain(F.col("d"))).select(F.lower("d").alias("value"))
    ev_dom = alerts.select(F.col("evidence").getItem("domain").alias("value")) \
        .where(F.col("value").isNotNull() & _valid_domain(F.col("value")))
    iocs = alerts.select(F.explode("ioc").alias("v")).where(F.col("v").isNotNull())
    is_ip_ioc = F.col("v").rlike(r"^(?:\d{1,3}\.){3}\d{1,3}\b") & \
        (F.length("v") - F.length(F.replace(F.col("v"), F.lit("."), F.lit(""))) == 3)
    ioc_ip = iocs.where(is_ip_ioc).select(F.col("v").alias("value"))
    ioc_dom = iocs.where(~is_ip_ioc & _valid_domain(F.col("v"))).select(F.lower("v").alias("value"))
    ips = ip_text.unionByName(ioc_ip).distinct()
    domains = dom_text.unionByName(ev_dom).unionByName(ioc_dom).distinct()
    return {"ips": ips, "domains": domains}


# --- G2 from alerts ---------------------------------------------------------------

def anomaly_graph(flows: DataFrame, alerts: DataFrame, severities: tuple[str, ...] = ("HIGH", "MEDIUM")) -> dict[str, DataFrame]:
    """G2 of the detectors' results: the edges that touch an address or carry a name which an alert of one of the
    ``severities`` mentions (G5), with the nodes. Without such alerts: every valid edge, as with empty sets.

    The detectors run once: what their alerts mention is stored below the shared folder before the graph reads it.
    """
    found = alert_iocs(alerts.where(F.col("severity").isin(*severities)))
    path = scratch_dir(flows.sparkSession, "alert-iocs")
    found["ips"].withColumn("kind", F.lit("ip")).unionByName(found["domains"].withColumn("kind", F.lit("domain"))).write.parquet(path)
    stored = flows.sparkSession.read.schema("value string, kind string").parquet(path)
    ips, domains = (stored.where(F.col("kind") == kind).select("value") for kind in ("ip", "domain"))
    return build_graph(flows, min_bytes=0, highlight_ips=ips, highlight_domains=domains)
