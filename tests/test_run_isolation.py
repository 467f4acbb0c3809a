"""Detectors that fail, when planned or in a task, and the counts of a run."""

import pytest
from conftest import flows_df
from pyspark.sql import functions as F

from netsift.operators.detectors import BEHAVIOR_ENGINE
from netsift.plans.registry import Context, Detector, default_registry, read_run, run_reports


def in_a_task(flows, ctx, cfg):
    return default_registry().get(BEHAVIOR_ENGINE).fn(flows, ctx, cfg) \
        .withColumn("confidence", F.col("confidence") / F.raise_error("bad value in a row").cast("double"))


def when_planned(flows, ctx, cfg):
    raise KeyError("no such setting")


def names(reg):
    return [d.name for d in reg.ordered()]


def content(alerts):
    return sorted((r.engine_name, r.threat_type, r.severity, r.description, r.priority) for r in alerts.collect())


@pytest.fixture(scope="module")
def flows(spark):
    rows = [dict(src_ip="10.0.0.1", dst_ip=f"8.8.8.{i % 3}", dst_port=4000 + i, bidirectional_bytes=20_000_000, src2dst_bytes=19_000_000,
                 dst2src_bytes=10, bidirectional_packets=1000, application_name="DNS", requested_server_name=f"x{i}.bad.com",
                 protocol=17) for i in range(60)]
    return flows_df(spark, rows).cache()


def test_one_job_counts_every_detector(spark, flows, tmp_path):
    reg = default_registry()
    ctx = Context(spark, threat_domains=spark.createDataFrame([("bad.com",)], "value string"))
    want, _ = reg.run_all(flows, ctx)
    reports = reg.commit_all(flows, ctx, str(tmp_path))
    assert content(read_run(spark, str(tmp_path))) == content(want) != []
    counts = {r["engine_name"]: r["count"] for r in want.groupBy("engine_name").count().collect()}
    assert {r.name: r.detections for r in reports if r.detections} == counts
    assert all(r.status == "ok" for r in reports) and len({r.duration_s for r in reports}) == 1


def test_failing_detectors_are_left_out_and_reported(spark, flows, tmp_path):
    reg = default_registry()
    ctx = Context(spark, threat_domains=spark.createDataFrame([("bad.com",)], "value string"))
    want, _ = reg.run_all(flows, ctx)
    reg.register(Detector("faulty task", in_a_task, priority=15))
    reg.register(Detector("faulty plan", when_planned, priority=16))
    reg.register(Detector("off", when_planned, priority=17, enabled=False))
    reg.commit_all(flows, ctx, str(tmp_path))
    assert content(read_run(spark, str(tmp_path))) == content(want)
    stats = {r.name: r for r in run_reports(spark, str(tmp_path)).collect()}
    assert set(stats) == set(names(reg))
    assert stats["faulty task"].health == "error" and "bad value in a row" in stats["faulty task"].last_error
    assert stats["faulty plan"].health == "error" and "no such setting" in stats["faulty plan"].last_error
    assert stats["off"].health == "disabled" and stats["off"].detections == 0
    assert sum(s.detections for s in stats.values()) == len(content(want))
    reg.unregister("faulty task")
    reg.commit_all(flows, ctx, str(tmp_path))  # the next run replaces it
    assert "faulty task" not in {r.name for r in run_reports(spark, str(tmp_path)).collect()}
    assert content(read_run(spark, str(tmp_path))) == content(want)


def test_all_failing_is_an_error(spark, flows, tmp_path):
    reg = default_registry()
    for n in names(reg):
        reg.unregister(n)
    assert reg.commit_all(flows, Context(spark), str(tmp_path / "none")) == []
    assert read_run(spark, str(tmp_path / "none")).collect() == []
    reg.register(Detector("faulty task", in_a_task))
    with pytest.raises(Exception, match="bad value in a row"):
        reg.commit_all(flows, Context(spark), str(tmp_path / "bad"))
