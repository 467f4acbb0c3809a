"""Anomaly scoring (P13, M1, M2, M3, A13) and the distributed exact quantile."""

import random

import numpy as np
from conftest import flows_df
from pyspark.sql import functions as F

from netsift.operators import anomaly as an
from netsift.operators.quantiles import approx_quantiles, exact_quantiles


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(7)
    vals = [float(rnd.choice([rnd.randint(0, 50), rnd.random() * 1e6, 3.0])) for _ in range(3000)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    clean = np.array([v for v in vals if v is not None and v == v])
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = exact_quantiles(df, {"x": F.col("x")}, q, partitions=5)["x"]
        assert abs(got - np.quantile(clean, q)) <= 1e-9 * max(1.0, abs(got)), q


def test_exact_quantiles_several_columns_and_empty(spark):
    df = spark.createDataFrame([(i, None) for i in range(11)], "a long, b double")
    got = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, 0.5)
    assert got == {"a": 5.0, "b": None}
    assert approx_quantiles(df, {"a": F.col("a")}, 0.5)["a"] == 5.0


def test_planted_outlier_ranks_first(spark):
    rows = [dict(src_ip="a", bidirectional_bytes=b, bidirectional_packets=p, bidirectional_duration_ms=float(d))
            for b, p, d in [(100, 10, 100), (200, 20, 200), (300, 30, 300), (10000, 1000, 50000)]]
    scored = an.score_flows(flows_df(spark, rows)).orderBy(F.desc("anomaly_score")).collect()
    assert scored[0].bidirectional_bytes == 10000
    assert scored[0].anomaly_score == 1.0 and scored[0].is_anomaly


def test_scores_match_pandas_restatement(spark):
    rnd = random.Random(3)
    rows = [dict(bidirectional_bytes=rnd.randint(1, 10**6), bidirectional_packets=rnd.randint(1, 1000),
                 bidirectional_duration_ms=rnd.random() * 1e4) for _ in range(500)]
    import pandas as pd
    pdf = pd.DataFrame(rows).astype(float)
    s = pd.Series(0.0, index=pdf.index)
    for c in ["bidirectional_bytes", "bidirectional_packets", "bidirectional_duration_ms"]:
        med = pdf[c].median()
        mad = (pdf[c] - med).abs().median()
        if mad > 0:
            s += ((pdf[c] - med) / mad).abs()
    s = s / s.max()
    thr = s.quantile(0.95)
    out = an.score_flows(flows_df(spark, rows)).select("bidirectional_bytes", "bidirectional_packets",
                                                      "anomaly_score", "is_anomaly").collect()
    exp = {(int(b), int(p)): (sc, sc >= thr) for b, p, sc in zip(pdf.bidirectional_bytes, pdf.bidirectional_packets, s)}
    for r in out:
        sc, flag = exp[(r.bidirectional_bytes, r.bidirectional_packets)]
        assert abs(r.anomaly_score - sc) < 1e-12 and r.is_anomaly == flag


def test_no_feature_columns_gives_zero(spark):
    df = spark.createDataFrame([("1.1.1.1", "2.2.2.2", 1)], "src_ip string, dst_ip string, some_col int")
    scored, _ = an.robust_scores(df)
    assert scored.collect()[0].anomaly_score == 0.0


def test_empty_frame(spark):
    df = flows_df(spark, [dict(src_ip="x")]).limit(0)
    out = an.score_flows(df)
    assert "anomaly_score" in out.columns and "is_anomaly" in out.columns and out.count() == 0


def test_clean_feature_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (2.5,)], "x double")
    assert [r.c for r in df.select(an.clean_feature("x").alias("c")).collect()] == [0.0, 0.0, 1e10, 1e10, 2.5]


def test_standard_scale_population_std(spark):
    rows = [dict(bidirectional_bytes=v, bidirectional_packets=7) for v in (1, 2, 3, 4)]
    scaled, params = an.standard_scale(flows_df(spark, rows), ["bidirectional_bytes", "bidirectional_packets"])
    got = [r.bidirectional_bytes for r in scaled.collect()]
    exp = (np.array([1, 2, 3, 4]) - 2.5) / np.std([1, 2, 3, 4])
    assert np.allclose(sorted(got), exp)
    assert all(r.bidirectional_packets == 0.0 for r in scaled.collect())  # zero deviation scales by 1


def test_anomaly_summary(spark):
    rows = [dict(src_ip=str(i), bidirectional_bytes=i, bidirectional_packets=i, bidirectional_duration_ms=float(i))
            for i in range(1, 101)]
    s = an.anomaly_summary(an.score_flows(flows_df(spark, rows)))
    r = s["summary"].collect()[0]
    sc = np.abs(np.arange(1, 101) - 50.5)
    sc = sc / sc.max()
    n = int((sc >= np.quantile(sc, 0.95)).sum())
    assert r.total_flows == 100 and r.anomaly_count == n and abs(r.anomaly_rate - n) < 1e-12
    assert s["top_anomalies"].count() == n
