"""Detector surface (X1-X5): detector records, a registry, run-all, statistics.

A detector is a function ``(flows, context, config) -> DataFrame[ALERT_SCHEMA]``.
Running all detectors builds one lazy plan (``unionByName`` in priority
order); a detector that fails while its plan is built or analysed is skipped
and reported. ``commit_all`` writes the alerts and also isolates detectors that
fail in a task, as the reference skips a failing plugin.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from netsift.operators import detectors as det
from netsift.operators import fused
from netsift.operators.alerts import empty_alerts, union_alerts
from netsift.schema import ALERT_COLUMNS

log = logging.getLogger(__name__)


@dataclass
class Context:
    """The indicator sets handed to detectors (one-column ``value`` frames)."""

    spark: SparkSession
    threat_domains: DataFrame | None = None
    threat_ips: DataFrame | None = None
    threat_urls: DataFrame | None = None
    safe_domains: DataFrame | None = None
    suspicious_ua: DataFrame | None = None
    phishing_keywords: DataFrame | None = None
    domain_scores: DataFrame | None = None
    #: Columns of the flow source before ``conform`` added the missing ones; None: those of the flows.
    source_columns: list[str] | None = None
    extra: dict = field(default_factory=dict)


DetectorFn = Callable[[DataFrame, Context, dict], DataFrame]


@dataclass
class Detector:
    """A detector record."""

    name: str
    fn: DetectorFn
    priority: int = 100
    version: str = "1.0.0"
    description: str = ""
    tags: list[str] = field(default_factory=list)
    enabled: bool = True
    config: dict = field(default_factory=dict)
    #: The detector without its per-flow rules, for registries that run those of all engines in one scan.
    grouped_fn: DetectorFn | None = None

    def run(self, flows: DataFrame, ctx: Context) -> DataFrame:
        return self.fn(flows, ctx, self.config)


@dataclass
class RunReport:
    name: str
    priority: int
    status: str
    error: str | None = None
    detections: int = 0
    duration_s: float = 0.0


#: Flows on which each detector is tried before the joint job.
PROBE_ROWS = 1000
REPORT_SCHEMA = "name string, priority int, status string, error string, detections bigint, duration_s double"


class Registry:
    """Register (re-registering replaces), unregister, enable, disable, configure."""

    def __init__(self, fused_scan: bool = False) -> None:
        self._d: dict[str, Detector] = {}
        self.fused_scan = fused_scan

    def register(self, d: Detector) -> None:
        self._d[d.name] = d

    def unregister(self, name: str) -> bool:
        return self._d.pop(name, None) is not None

    def enable(self, name: str) -> bool:
        return self._set(name, enabled=True)

    def disable(self, name: str) -> bool:
        return self._set(name, enabled=False)

    def set_config(self, name: str, config: dict) -> bool:
        return self._set(name, config=dict(config))

    def _set(self, name: str, **kw) -> bool:
        if name not in self._d:
            return False
        for k, v in kw.items():
            setattr(self._d[name], k, v)
        return True

    def get(self, name: str) -> Detector | None:
        return self._d.get(name)

    def ordered(self) -> list[Detector]:
        return sorted(self._d.values(), key=lambda d: (d.priority, d.name))

    def run_all(self, flows: DataFrame, ctx: Context) -> tuple[DataFrame, list[RunReport]]:
        """Every enabled detector in priority order, as one lazy union with
        a ``priority`` column. A detector whose plan doesn't analyse is reported
        and skipped; any other error (a lost executor, say) is raised, so that no
        detector's alerts can be missing unnoticed.

        With ``fused_scan`` the per-flow rules of all enabled engines run in one
        scan; each alert keeps its engine's name and priority.
        """
        frames, prios, reports = [], [], []
        shared: dict[str, int] = {}
        for d in self.ordered():
            if not d.enabled:
                reports.append(RunReport(d.name, d.priority, "disabled"))
                continue
            try:
                split = self.fused_scan and d.grouped_fn is not None
                out = (d.grouped_fn if split else d.fn)(flows, ctx, d.config).select(*ALERT_COLUMNS)
                out.schema  # forces analysis so broken plans surface here
                frames.append(out)
                prios.append(d.priority)
                if split:
                    shared[d.name] = d.priority
                reports.append(RunReport(d.name, d.priority, "ok"))
            except AnalysisException as e:
                log.warning("detector %s failed: %s", d.name, e)
                reports.append(RunReport(d.name, d.priority, "error", str(e)[:500]))
        if shared:
            engine = F.col("engine_name")
            priority = F.coalesce(*[F.when(engine == name, F.lit(p)) for name, p in shared.items()])
            per_flow = fused.per_flow_alerts(flows).where(engine.isin(*shared)).select(*ALERT_COLUMNS, priority.alias("priority"))
            rest = union_alerts(frames, prios)
            return rest.unionByName(per_flow), reports
        if not frames:
            return empty_alerts(ctx.spark).withColumn("priority", F.lit(0)), reports
        return union_alerts(frames, prios), reports

    def commit_all(self, flows: DataFrame, ctx: Context, path: str) -> list[RunReport]:
        """Every enabled detector's alerts under ``path``, those of a detector that fails left out and reported.

        All detectors run in one job that counts each one's alerts as they are
        written (``DataFrame.observe``). If it fails in a task, each detector is
        run and written by itself, so the error stays with the one that raised
        it: ``error`` in its report, none of its alerts in the table, all of the
        others'. A detector that fails on the first ``PROBE_ROWS`` flows runs by
        itself at once, over all flows like the others, so that it doesn't
        take the others' job down late. The manifest, written last, names what counts; ``read_run``
        goes by it. An error that is no detector's own (storage that can't be
        written, say) shows up in every report, and then the first is raised.
        """
        path = path.rstrip("/")
        frames, reports = {}, []
        for d in self.ordered():
            report = RunReport(d.name, d.priority, "ok" if d.enabled else "disabled")
            reports.append(report)
            if not d.enabled:
                continue
            try:
                frames[d.name] = d.run(flows, ctx).select(*ALERT_COLUMNS, F.lit(d.priority).alias("priority"), F.lit(d.name).alias("detector"))
                frames[d.name].schema  # forces analysis
            except Exception as e:  # a detector is foreign code: whatever it raises is its own failure
                frames.pop(d.name, None)
                report.status, report.error = "error", str(e)[:500]
        run = f"{path}/run={uuid.uuid4().hex}"
        good = [r for r in reports if r.name in frames]
        alone = self._failing_on_few(flows, ctx, good)
        others = [r for r in good if r not in alone]
        if not self._commit_together({r.name: frames[r.name] for r in others}, others, f"{run}/together"):
            alone = good
        errors = [e for r in alone if (e := self._commit_alone(frames[r.name], r, f"{run}/alone-{r.name}"))]
        if errors and len(errors) == len(good):
            raise errors[0]
        rows = [(r.name, r.priority, r.status, r.error, r.detections, r.duration_s) for r in reports]
        ctx.spark.createDataFrame(rows, REPORT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{run}/manifest")
        ctx.spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").parquet(f"{path}/latest")
        return reports

    def _failing_on_few(self, flows: DataFrame, ctx: Context, reports: list[RunReport]) -> list[RunReport]:
        """Those whose detector fails on a few flows: a guess which ones to keep out of the joint job, no verdict."""
        few = ctx.spark.createDataFrame(flows.limit(PROBE_ROWS).collect(), flows.schema)
        failing = []
        for r in reports:
            try:
                self._d[r.name].run(few, ctx).write.format("noop").mode("overwrite").save()
            except Exception as e:
                log.warning("detector %s fails on %d flows, it runs by itself: %s", r.name, PROBE_ROWS, str(e)[:500])
                failing.append(r)
        return failing

    def _commit_together(self, frames: dict[str, DataFrame], reports: list[RunReport], path: str) -> bool:
        if not frames:
            return True
        seen = {name: Observation(f"detections-{i}") for i, name in enumerate(frames)}
        watched = [f.observe(seen[name], F.count(F.lit(1)).alias("n")) for name, f in frames.items()]
        t0 = time.time()
        try:
            reduce(DataFrame.unionByName, watched).write.mode("overwrite").partitionBy("detector").parquet(path)
        except Exception as e:
            log.warning("the joint run failed, detectors run one by one: %s", str(e)[:500])
            return False
        duration = time.time() - t0
        for r in reports:
            r.detections, r.duration_s = int(seen[r.name].get["n"]), duration
        return True

    def _commit_alone(self, frame: DataFrame, report: RunReport, path: str) -> Exception | None:
        count = Observation()
        t0 = time.time()
        try:
            frame.observe(count, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("detector").parquet(path)
            report.detections = int(count.get["n"])
        except Exception as e:
            report.status, report.error = "error", str(e)[:500]
            log.warning("detector %s failed: %s", report.name, report.error)
            return e
        finally:
            report.duration_s = time.time() - t0
        return None

    def run_statistics(self, flows: DataFrame, ctx: Context, path: str) -> DataFrame:
        """Per detector its detections, wall time, health and last error, from the one job of ``commit_all``.

        The wall time is that of the job a detector ran in, together with others or alone.
        """
        self.commit_all(flows, ctx, path)
        return run_reports(ctx.spark, path)


def _latest_run(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path.rstrip('/')}/latest").first()["run"]


def run_reports(spark: SparkSession, path: str) -> DataFrame:
    """(name, priority, detections, duration_s, health, last_error) of the latest run under ``path``."""
    health = F.when(F.col("status") == "ok", "healthy").otherwise(F.col("status"))
    return spark.read.parquet(f"{_latest_run(spark, path)}/manifest") \
        .select("name", "priority", "detections", "duration_s", health.alias("health"), F.col("error").alias("last_error"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of the latest run that ``commit_all`` wrote, with ``priority``: only detectors whose status is ``ok``."""
    run = _latest_run(spark, path)
    found = [r for r in spark.read.parquet(f"{run}/manifest").collect() if r["status"] == "ok"]  # a row per detector
    schema = empty_alerts(spark).withColumn("priority", F.lit(0)).withColumn("detector", F.lit("")).schema
    frames = []
    for folder in ("together", *[f"alone-{r['name']}" for r in found]):
        try:
            frames.append(spark.read.schema(schema).parquet(f"{run}/{folder}"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not frames:
        return spark.createDataFrame([], schema).drop("detector")
    return reduce(DataFrame.unionByName, frames).where(F.col("detector").isin([r["name"] for r in found])).drop("detector")


def detections_by_engine(alerts: DataFrame) -> DataFrame:
    """X4 from the alerts themselves: counts per engine (no extra jobs)."""
    return alerts.groupBy("engine_name").agg(F.count(F.lit(1)).alias("detections"))


# --- the built-in engines -------------------------------------------------------

def _safe(ctx: Context, cfg: dict):
    """Safe-domain suppression is off unless ``suppress_safe_domains`` is set."""
    return ctx.safe_domains if cfg.get("suppress_safe_domains") else None


def _dns_engine(flows: DataFrame, ctx: Context, cfg: dict) -> DataFrame:
    parts = []
    safe = _safe(ctx, cfg)
    if ctx.threat_domains is not None:
        parts.append(det.threat_domains_alerts(flows, ctx.threat_domains, safe))
    parts.append(det.unknown_domains_alerts(flows, ctx.domain_scores, safe))
    parts.append(det.dns_tunnel_alerts(flows, cfg.get("dns_tunnel_threshold", det.DNS_TUNNEL_PACKETS)))
    parts.append(det.dga_domains_alerts(flows, safe))
    return union_alerts(parts)


def _http_engine(flows: DataFrame, ctx: Context, cfg: dict) -> DataFrame:
    return union_alerts([det.http_exfiltration_alerts(flows), det.uncommon_ports_alerts(flows),
                         det.suspicious_user_agents_alerts(flows)])


def _http_grouped(flows: DataFrame, ctx: Context, cfg: dict) -> DataFrame:
    return det.uncommon_ports_alerts(flows)


def _tls(flows: DataFrame, ctx: Context, cfg: dict) -> DataFrame:
    """Without the confidence column in the source every TLS flow counts, unless the config says otherwise."""
    present = "application_confidence" in (flows.columns if ctx.source_columns is None else ctx.source_columns)
    return det.unknown_tls_alerts(flows, cfg.get("require_confidence", present))


def _covert_engine(flows: DataFrame, ctx: Context, cfg: dict) -> DataFrame:
    return union_alerts([det.icmp_tunnel_alerts(flows), det.dns_exfiltration_alerts(flows),
                         _tls(flows, ctx, cfg), det.one_way_transfer_alerts(flows)])


def _covert_grouped(flows: DataFrame, ctx: Context, cfg: dict) -> DataFrame:
    return _tls(flows, ctx, cfg)


def _behavior_engine(flows: DataFrame, ctx: Context, cfg: dict) -> DataFrame:
    return union_alerts([det.large_transfers_alerts(flows), det.suspicious_communication_alerts(flows),
                         det.port_scan_alerts(flows)])


def _behavior_grouped(flows: DataFrame, ctx: Context, cfg: dict) -> DataFrame:
    return det.port_scan_alerts(flows)


def _plugin_port_scan(flows: DataFrame, ctx: Context, cfg: dict) -> DataFrame:
    return det.plugin_port_scan_alerts(flows, cfg.get("port_threshold", det.PLUGIN_SCAN_THRESHOLD))


def default_registry(fused_scan: bool = False, with_plugin: bool = False) -> Registry:
    """The reference's four engines at priorities 10/20/30/40. With
    ``fused_scan`` the seven per-flow rules run in one scan instead."""
    r = Registry(fused_scan)
    r.register(Detector(det.DNS_ENGINE, _dns_engine, priority=10, version="3.0.0",
                        config={"dns_tunnel_threshold": det.DNS_TUNNEL_PACKETS, "suppress_safe_domains": False}))
    r.register(Detector(det.HTTP_ENGINE, _http_engine, priority=20, version="2.0.0", grouped_fn=_http_grouped))
    r.register(Detector(det.COVERT_ENGINE, _covert_engine, priority=30, version="2.0.0", grouped_fn=_covert_grouped))
    r.register(Detector(det.BEHAVIOR_ENGINE, _behavior_engine, priority=40, version="2.0.0", grouped_fn=_behavior_grouped))
    if with_plugin:
        r.register(Detector(det.PLUGIN_SCAN_ENGINE, _plugin_port_scan, priority=50,
                            config={"port_threshold": 15}))
    return r
