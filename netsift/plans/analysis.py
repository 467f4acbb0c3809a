"""Full analysis (X6): the reference's ``analyze`` stages as one set of
DataFrames over a flow table.

Stages: anomaly scoring (M1/M2) → registry detectors (X3) → domain
reputation triage (J8/J9/D17) → IP reputation (J6/J7/D16/D18) → totals and
counts (A1-A3, A10, A11, A13). Only the anomaly scalars are computed eagerly;
everything else is a lazy plan the caller writes or collects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.operators import anomaly as an
from netsift.operators import detectors as det
from netsift.operators import flows as fl
from netsift.operators import reputation as rp
from netsift.operators.alerts import counts_by, severity_counts
from netsift.plans.registry import Context, Registry, default_registry
from netsift.schema import ALERT_COLUMNS
from netsift.session import cut_lineage

DOMAIN_INTEL_PRIORITY = 90
IP_INTEL_PRIORITY = 95


def analyze(flows: DataFrame, ctx: Context, registry: Registry | None = None,
            domain_reputation: DataFrame | None = None, ip_cache: DataFrame | None = None,
            ip_service: DataFrame | None = None, contamination: float = an.CONTAMINATION,
            quantile_method: str = "exact", materialize: bool = False) -> dict:
    """Run every stage; returns named DataFrames plus the detector run reports.

    ``materialize`` checkpoints the alert table (reliable storage under
    ``spark.checkpoint.dir``) so the several reports built on it do not
    re-run the detectors, and executor loss cannot lose it.
    """
    registry = registry or default_registry(fused_scan=True)
    scored = an.score_flows(flows, contamination, quantile_method)
    alerts, reports = registry.run_all(flows, ctx)
    extra = []
    if domain_reputation is not None:
        flagged = det.unknown_domain_names(flows, ctx.domain_scores)
        extra.append(rp.domain_threats_alerts(flows, domain_reputation, flagged=flagged)
                     .withColumn("priority", F.lit(DOMAIN_INTEL_PRIORITY)))
    malicious = None
    if ip_service is not None:
        cache = ip_cache if ip_cache is not None else ip_service.limit(0).transform(rp.cache_from_snapshot)
        extra.append(rp.malicious_ips_alerts(flows, cache, ip_service)
                     .withColumn("priority", F.lit(IP_INTEL_PRIORITY)))
        malicious = rp.malicious_ip_listing(flows, cache, ip_service)
    all_alerts = alerts.select(*ALERT_COLUMNS, "priority")
    for e in extra:
        all_alerts = all_alerts.unionByName(e.select(*ALERT_COLUMNS, "priority"))
    if materialize:
        all_alerts = cut_lineage(all_alerts)
    anomalies = an.anomaly_summary(scored)
    return {
        "flows": scored,
        "alerts": all_alerts,
        "summary": fl.traffic_summary(flows),
        "protocols": fl.protocol_distribution(flows),
        "top_talkers": fl.top_talkers(flows),
        "top_destinations": fl.top_destinations(flows),
        "severity_counts": severity_counts(all_alerts),
        "type_counts": counts_by(all_alerts, "threat_type"),
        "engine_counts": counts_by(all_alerts, "engine_name"),
        "anomaly_summary": anomalies["summary"],
        "top_anomalies": anomalies["top_anomalies"],
        "malicious_ips": malicious,
        "reports": reports,
    }


__all__ = ["analyze", "Context"]
