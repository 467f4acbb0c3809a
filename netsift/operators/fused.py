"""All per-flow detectors (D5, D7, D8, D9, D11, D12, D13) in one scan.

The unioned form reads the flow table once per detector. Here one pass
evaluates the seven rules per flow, explodes the ids of the rules that hold
(``explode(array(when(rule_i, i)))`` — a code-generated generator, no
higher-order function) and builds each alert field with one CASE on the
rule id: one scan, one stage, no shuffle, and the same rows as the union of
the seven detectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions import ip as ipf
from netsift.operators import detectors as det
from netsift.operators.alerts import ioc_array

_FIELDS = ["engine_name", "threat_type", "severity", "description", "evidence", "confidence", "ioc",
           "mitre_technique", "recommended_action"]


def _evidence(ev: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in ev.items() for x in (F.lit(k), v.cast("string"))])


def _rules() -> list[tuple[Column, dict]]:
    c = F.col
    s, d = c("src2dst_bytes"), c("dst2src_bytes")
    b, pk = c("bidirectional_bytes"), c("bidirectional_packets")
    hits = det.ua_hits(c("user_agent"))
    return [
        (c("application_name").isin(*det.HTTP_APPS) & (s > 0) & (d > s * det.HTTP_RATIO) & (d > det.HTTP_MIN_RESPONSE),
         dict(engine=det.HTTP_ENGINE, ttype="HTTP_EXFILTRATION", severity="MEDIUM", confidence=0.5,
              description=F.format_string("HTTP response is %.1f times the request", d / s),
              evidence={"src_ip": c("src_ip"), "dst_ip": c("dst_ip"), "ratio": d / s}, ioc=[c("dst_ip")],
              action="Check for unexpected downloads")),
        (c("user_agent").isNotNull() & (F.size(hits) > 0),
         dict(engine=det.HTTP_ENGINE, ttype="SUSPICIOUS_USER_AGENT", severity="MEDIUM", confidence=0.65,
              description=F.concat(F.lit("Suspicious user agent: "), F.substring("user_agent", 1, 50)),
              evidence={"ua": c("user_agent"), "hits": F.array_join(hits, ",")}, ioc=[],
              action="Agent commonly used by automated tools")),
        ((c("protocol") == 1) & (b > det.ICMP_MIN_BYTES),
         dict(engine=det.COVERT_ENGINE, ttype="ICMP_TUNNEL", severity="HIGH", confidence=0.7,
              description=F.format_string("Large ICMP flow: %d bytes (%s -> %s)", b, c("src_ip"), c("dst_ip")),
              evidence={"bytes": b, "src": c("src_ip"), "dst": c("dst_ip")}, ioc=[c("dst_ip")],
              action="Ping packets are small; large ICMP volume suggests tunnelling")),
        ((c("application_name") == "DNS") & (b > det.DNS_EXFIL_BYTES),
         dict(engine=det.COVERT_ENGINE, ttype="DNS_EXFILTRATION", severity="HIGH", confidence=0.65,
              description=F.format_string("Large DNS flow: %d bytes", b), evidence={"bytes": b, "dst": c("dst_ip")},
              ioc=[c("dst_ip")], action="DNS queries are small; large volume may be exfiltration")),
        ((s > d * det.ONE_WAY_RATIO) & (s > det.ONE_WAY_MIN_BYTES),
         dict(engine=det.COVERT_ENGINE, ttype="C2_DATA_EXFIL", severity="HIGH", confidence=0.7,
              description=F.format_string("One-way transfer: %.2f MB to %s", s / 1e6, c("dst_ip")),
              evidence={"dst": c("dst_ip"), "bytes": s}, ioc=[c("dst_ip")],
              action="Strongly asymmetric traffic is typical of exfiltration")),
        (b > det.LARGE_TRANSFER_BYTES,
         dict(engine=det.BEHAVIOR_ENGINE, ttype="LARGE_DATA_TRANSFER", severity="MEDIUM", confidence=0.5,
              description=F.format_string("Large transfer: %.2f MB", b / 1e6),
              evidence={"bytes": b, "src": c("src_ip"), "dst": c("dst_ip")}, ioc=[c("dst_ip")],
              action="Confirm the transfer is expected")),
        (ipf.is_private_pattern("src_ip") & ~ipf.is_private_pattern("dst_ip") & ~ipf.has_safe_prefix("dst_ip")
         & (pk > det.SUSPICIOUS_COMM_PACKETS),
         dict(engine=det.BEHAVIOR_ENGINE, ttype="SUSPICIOUS_COMMUNICATION", severity="MEDIUM", confidence=0.55,
              description=F.format_string("Internal %s sent %d packets to unknown external %s", c("src_ip"), pk,
                                          c("dst_ip")),
              evidence={"src": c("src_ip"), "dst": c("dst_ip"), "packets": pk}, ioc=[c("dst_ip")],
              action="Check the internal host for a C2 implant")),
    ]


def _case(rule: Column, values: list[Column]) -> Column:
    out = F.when(rule == 0, values[0])
    for i, v in enumerate(values[1:], start=1):
        out = out.when(rule == i, v)
    return out


def per_flow_alerts(flows: DataFrame) -> DataFrame:
    """D5, D7, D8, D9, D11, D12 and D13 as ALERT_SCHEMA rows from one scan."""
    rules = _rules()
    matched = F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(i)) for i, (r, _) in enumerate(rules)])
    x = flows.select("*", F.explode(matched).alias("_rule")).where(F.col("_rule").isNotNull())
    r = F.col("_rule")
    specs = [spec for _, spec in rules]
    return x.select(
        _case(r, [F.lit(sp["engine"]) for sp in specs]).alias("engine_name"),
        _case(r, [F.lit(sp["ttype"]) for sp in specs]).alias("threat_type"),
        _case(r, [F.lit(sp["severity"]) for sp in specs]).alias("severity"),
        _case(r, [sp["description"].cast("string") for sp in specs]).alias("description"),
        _case(r, [_evidence(sp["evidence"]) for sp in specs]).alias("evidence"),
        _case(r, [F.lit(sp["confidence"]).cast("double") for sp in specs]).alias("confidence"),
        _case(r, [ioc_array(*sp["ioc"]) for sp in specs]).alias("ioc"),
        F.lit(None).cast("string").alias("mitre_technique"),
        _case(r, [F.lit(sp["action"]) for sp in specs]).alias("recommended_action"),
    )
