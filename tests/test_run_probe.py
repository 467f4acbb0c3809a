"""A detector that fails on any flow doesn't make the others run twice."""

from conftest import flows_df
from pyspark.sql import functions as F

from netsift.operators.detectors import BEHAVIOR_ENGINE
from netsift.plans.registry import Context, Detector, Registry, default_registry, read_run, run_reports


def test_others_share_one_job_beside_a_failing_detector(spark, tmp_path, monkeypatch):
    rows = [dict(src_ip="10.0.0.1", dst_ip="8.8.8.8", dst_port=4000 + i, bidirectional_bytes=20_000_000, src2dst_bytes=19_000_000,
                 dst2src_bytes=10, bidirectional_packets=1000, protocol=17) for i in range(60)]
    flows = flows_df(spark, rows)
    reg = default_registry()
    want = reg.run_all(flows, Context(spark))[0].count()

    def fails(flows, ctx, cfg):
        return reg.get(BEHAVIOR_ENGINE).fn(flows, ctx, cfg).withColumn("confidence", F.raise_error("bad row").cast("double"))

    reg.register(Detector("faulty", fails, priority=15))
    ran_alone = []
    alone = Registry._commit_alone
    monkeypatch.setattr(Registry, "_commit_alone", lambda self, frame, report, path: ran_alone.append(report.name) or alone(self, frame, report, path))
    reports = {r.name: r for r in reg.commit_all(flows, Context(spark), str(tmp_path))}
    assert ran_alone == ["faulty"] and reports["faulty"].status == "error" and "bad row" in reports["faulty"].error
    assert len({r.duration_s for r in reports.values() if r.name != "faulty"}) == 1
    assert read_run(spark, str(tmp_path)).count() == want == sum(r.detections for r in reports.values()) > 0


def test_a_detector_that_fails_only_on_few_flows_counts(spark, tmp_path):
    flows = flows_df(spark, [dict(dst_ip="8.8.8.8", dst_port=4000, bidirectional_packets=1)] * 1200)

    def needs_many(flows, ctx, cfg):
        enough = F.when(F.col("n") > 1000, F.col("n")).otherwise(F.raise_error(F.lit("too few")).cast("bigint"))
        from netsift.operators.alerts import to_alerts
        return to_alerts(flows.agg(F.count(F.lit(1)).alias("n")), engine="many", threat_type="MANY", severity="LOW", confidence=0.5,
                         description=F.concat(F.lit("n "), enough.cast("string")), evidence={"n": F.col("n")}, ioc=[])

    reg = Registry()
    reg.register(Detector("many", needs_many))
    reg.commit_all(flows, Context(spark), str(tmp_path))
    assert [r.description for r in read_run(spark, str(tmp_path)).collect()] == ["n 1200"]
    assert run_reports(spark, str(tmp_path)).first()["health"] == "healthy"
