"""Learned operators: isolation forest (M4, M5, S13) and the domain classifier."""

import os
import random
import tempfile

from conftest import flows_df
from pyspark.sql import functions as F

from netsift.operators import domain_model as dm
from netsift.operators import iforest as ifo


def _anomaly_flows(spark, n=400, outliers=4):
    rnd = random.Random(42)
    rows = []
    for i in range(n):
        rows.append(dict(src_ip=f"10.0.0.{i % 250}", dst_ip="8.8.8.8", dst_port=rnd.choice([80, 443, 53, 8080]),
                         bidirectional_packets=rnd.randint(5, 15), src2dst_packets=5, dst2src_packets=5,
                         bidirectional_bytes=int(rnd.gauss(1000, 100)), src2dst_bytes=500, dst2src_bytes=500,
                         bidirectional_duration_ms=rnd.expovariate(1 / 100.0), bidirectional_mean_ps=100.0,
                         bidirectional_stddev_ps=10.0, bidirectional_mean_piat_ms=5.0, bidirectional_stddev_piat_ms=1.0))
    for j in range(outliers):
        rows.append(dict(src_ip=f"6.6.6.{j}", dst_ip="9.9.9.9", dst_port=4444, bidirectional_packets=5000,
                         src2dst_packets=4000, dst2src_packets=1000, bidirectional_bytes=9_000_000,
                         src2dst_bytes=8_000_000, dst2src_bytes=1_000_000, bidirectional_duration_ms=90000.0,
                         bidirectional_mean_ps=1500.0, bidirectional_stddev_ps=400.0, bidirectional_mean_piat_ms=300.0,
                         bidirectional_stddev_piat_ms=80.0))
    return flows_df(spark, rows)


def test_every_tree_gets_rows_of_repeated_vectors(spark):
    rows = [dict(src_ip="10.0.0.1", dst_ip="8.8.8.8", bidirectional_packets=i % 6, bidirectional_bytes=100 * (i % 6)) for i in range(6000)]
    m = ifo.fit(flows_df(spark, rows), seed=3)
    assert m.nodes["tree"].nunique() == 100 and m.nodes.groupby("tree").size().min() > 1


def test_isolation_forest_properties(spark):
    df = _anomaly_flows(spark)
    m = ifo.fit(df, n_estimators=50, seed=7)
    assert m.max_samples == 256 and m.nodes["tree"].nunique() == 50
    out = ifo.predict(df, m)
    top = [r.src_ip for r in out.orderBy(F.desc("anomaly_score")).limit(4).collect()]
    assert all(ip.startswith("6.6.6.") for ip in top)
    rate = out.where("is_anomaly").count() / df.count()
    assert 0.03 <= rate <= 0.07
    path = os.path.join(tempfile.mkdtemp(prefix="netsift-if-"), "model")
    ifo.save(m, spark, path)
    m2 = ifo.load(spark, path)
    a = [r.anomaly_score for r in ifo.predict(df, m2).orderBy("src_ip", "bidirectional_bytes").collect()]
    b = [r.anomaly_score for r in out.orderBy("src_ip", "bidirectional_bytes").collect()]
    assert a == b


def test_domain_classifier_small(spark):
    names = [f"h{i}.site{i % 7}.example.org" for i in range(40)] + [f"{i:08x}{i * 7919:08x}q.xyz" for i in range(40)]
    lab = spark.createDataFrame([(n, 1.0 if n.endswith(".xyz") else 0.0) for n in names], "domain string, label double")
    train, test = dm.split(lab)
    assert train.count() + test.count() == 80
    model = dm.train(train, trees=10, depth=3)
    ev = dm.evaluate(model, test)
    assert ev.auc >= 0.9 and len(ev.importances) == 5
    s = dm.score(model, lab)
    assert set(s.columns) == {"domain", "probability", "is_suspicious"} and s.count() == 80


def test_split_is_exact_in_each_label(spark):
    lab = spark.createDataFrame([(f"a{i}.com", 0.0) for i in range(503)] + [(f"b{i}.xyz", 1.0) for i in range(7)], "domain string, label double")
    train, test = dm.split(lab)
    counts = lambda d: {r.label: r["count"] for r in d.groupBy("label").count().collect()}
    assert counts(train) == {0.0: 402, 1.0: 5} and counts(test) == {0.0: 101, 1.0: 2}
    assert train.intersect(test).isEmpty() and train.unionAll(test).exceptAll(lab).isEmpty()
    again, _ = dm.split(lab.repartition(3))
    assert again.exceptAll(train).isEmpty() and not dm.split(lab, seed=7)[0].exceptAll(train).isEmpty()


def test_area_under_curve_equals_all_pairs(spark):
    rnd = random.Random(4)
    for scores in ([rnd.random() for _ in range(300)], [rnd.choice([-1.0, 0.25, 3.5]) for _ in range(200)], [0.5] * 20):
        rows = [(float(rnd.random() < .3), s) for s in scores]
        pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        r = dm.area_under_curve(spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "label double, score double")).first()
        assert abs(r.auc - want) < 1e-12 and (r.positives, r.negatives) == (len(pos), len(neg))
    one = spark.createDataFrame([(1.0, 0.5)], "label double, score double")
    assert dm.area_under_curve(one).first().auc is None and dm.area_under_curve(one.limit(0)).first().positives == 0
