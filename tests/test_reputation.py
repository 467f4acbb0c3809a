"""Reputation cache (C1-C8), IP tiers (J6, J7, D16, D18), domain triage."""

from conftest import flows_df
from pyspark.sql import functions as F

from netsift.operators import reputation as rp

CACHE = "key string, level string, age_days int, abuse_score int, isp string"


def test_tiers_from_score(spark):
    df = spark.createDataFrame([(5, "x"), (80, "x"), (0, "Google LLC"), (0, "small isp"), (10, "Fastly"), (9, None)],
                               "abuse_score int, isp string")
    got = [r.l for r in df.select(rp.reputation_level(F.col("abuse_score"), "isp").alias("l")).collect()]
    assert got == ["safe", "malicious", "whitelist", "safe", "malicious", "safe"]


def test_cache_ttl_and_order(spark):
    c = spark.createDataFrame([("a", "whitelist", 9999, 0, None), ("a", "malicious", 1, 80, None),
                               ("b", "safe", 30, 1, None), ("c", "safe", 29, 1, None),
                               ("d", "malicious", 89, 50, None), ("d", "safe", 1, 1, None)], CACHE)
    got = {r.key: r.level for r in rp.cache_get(c).collect()}
    assert got == {"a": "whitelist", "c": "safe", "d": "safe"}
    tiers = {r.key: r.level for r in rp.cache_get(c, order=rp.TIER_ORDER).collect()}
    assert tiers["d"] == "malicious"
    kept, removed = rp.cache_expire(c)
    assert {r.level: r.removed for r in removed.collect()} == {"whitelist": 0, "malicious": 0, "safe": 1}
    assert kept.count() == 5


def test_cache_stats_hit_rate(spark):
    c = spark.createDataFrame([("k1", "safe", 0, 1, None), ("k2", "whitelist", 0, 0, None)], CACHE)
    lookups = spark.createDataFrame([("k1",), ("k2",), ("zz",)], "key string")
    r = rp.cache_stats(c, lookups).collect()[0]
    assert (r.hits, r.misses, round(r.hit_rate, 3)) == (2, 1, 0.667)
    assert (r.whitelist_size, r.safe_size, r.malicious_size) == (1, 1, 0)


def test_upsert_remove_clear(spark):
    c = spark.createDataFrame([("k1", "safe", 10, 1, None), ("k2", "malicious", 5, 70, None)], CACHE)
    new = spark.createDataFrame([("k1", "safe", 0, 2, None)], CACHE)
    up = {(r.key, r.level): r.abuse_score for r in rp.cache_upsert(c, new).collect()}
    assert up == {("k1", "safe"): 2, ("k2", "malicious"): 70}
    keys = spark.createDataFrame([("k1",)], "key string")
    assert [r.key for r in rp.cache_remove(c, keys).collect()] == ["k2"]
    assert rp.cache_remove(c, keys, level="malicious").count() == 2
    assert [r.key for r in rp.cache_clear(c, "safe").collect()] == ["k2"]


def test_hour_cache_and_days_left(spark):
    c = spark.createDataFrame([("old", "safe", 0, 1, None), ("new", "safe", 0, 1, None)], CACHE)
    hours = F.when(F.col("key") == "old", 100).otherwise(0)
    assert [r.key for r in rp.hour_cache_live(c, hours).collect()] == ["new"]
    d = spark.createDataFrame([("a", "safe", 29, 1, None), ("b", "safe", 30, 1, None)], CACHE)
    assert [(r.key, r.days_left) for r in rp.safe_days_left(d).collect()] == [("a", 1)]


def test_external_ips_and_malicious_lookup(spark):
    dsts = ["8.8.8.8", "1.1.1.1", "203.0.113.50", "192.168.1.1", "10.0.0.1", "127.0.0.1", "169.254.169.254"]
    flows = flows_df(spark, [dict(src_ip="192.168.1.100", dst_ip=d, bidirectional_bytes=1000) for d in dsts])
    ext = sorted(r.key for r in rp.external_destinations(flows).collect())
    assert ext == ["1.1.1.1", "8.8.8.8"]
    svc = spark.createDataFrame([("8.8.8.8", 0, "Google LLC", 0), ("1.1.1.1", 80, "APNIC", 0)],
                                "ip string, abuse_score int, isp string, age_days int")
    empty = spark.createDataFrame([], CACHE)
    mal = rp.malicious_ips(flows, empty, svc).collect()
    assert [(r.ip, r.severity, r.confidence) for r in mal] == [("1.1.1.1", "HIGH", 0.95)]
    cache = spark.createDataFrame([("1.1.1.1", "malicious", 3, 80, None)], CACHE)
    assert rp.pending_ips(flows, cache).count() == 1
    listing = {(r.ip, r.origin) for r in rp.malicious_ip_listing(flows, cache, svc).collect()}
    assert listing == {("1.1.1.1", "cache")}


def test_domain_gate_and_triage(spark):
    names = ["login.google.com", "abcdefghijklmnopqrstuvwxyz0123.xyz", "short.xyz", "evil-a-b-c.tk", "q9w8e7r6t5y4u3.top"]
    flows = flows_df(spark, [dict(application_name="DNS", requested_server_name=n, src_ip="10.0.0.1") for n in names])
    gated = {r.domain for r in rp.gate_domains(rp.candidate_domains(flows)).collect()}
    assert gated == {"abcdefghijklmnopqrstuvwxyz0123.xyz", "evil-a-b-c.tk", "q9w8e7r6t5y4u3.top"}
    rep = spark.createDataFrame([("evil-a-b-c.tk", "malicious", "Other", True),
                                 ("q9w8e7r6t5y4u3.top", "info", "Whitelist", False),
                                 ("abcdefghijklmnopqrstuvwxyz0123.xyz", "info", "Other", False)],
                                "domain string, severity string, judgment string, is_malicious boolean")
    tri = {r.domain: r.outcome for r in rp.triage_domains(flows, rep).collect()}
    assert tri == {"evil-a-b-c.tk": "threat", "q9w8e7r6t5y4u3.top": "whitelist",
                   "abcdefghijklmnopqrstuvwxyz0123.xyz": "safe"}
    thr = rp.domain_threats(flows, rep).collect()
    assert [(r.domain, r.alert_severity, r.query_count) for r in thr] == [("evil-a-b-c.tk", "HIGH", 1)]
    wl = spark.createDataFrame([("evil-a-b-c.tk", "whitelist", 0, 0, None)], CACHE)
    assert rp.domain_threats(flows, rep, whitelist=wl).count() == 0
