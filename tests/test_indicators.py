"""Feeds (S4-S10), indicator maintenance (I1-I6, A15, F11) and lookups."""

import gzip
import hashlib
import json
import os
import tempfile

from pyspark.sql import functions as F

from netsift.operators import indicators as ind
from netsift.sources import feeds as fd
from netsift.sources.builtin import builtin_indicators, default_safe_domains

NOW = "2026-01-01 00:00:00"


def _write(content: str, name: str, compress: bool = False) -> str:
    d = tempfile.mkdtemp(prefix="netsift-feed-")
    p = os.path.join(d, name)
    if compress:
        with gzip.open(p, "wt") as f:
            f.write(content)
    else:
        with open(p, "w") as f:
            f.write(content)
    return p


def _vals(df):
    return sorted(r.value for r in df.collect())


def test_text_feed(spark):
    p = _write("# header\n\n  a.com  \nb.com\n   # kept\n\t\nb.com\n", "t.txt")
    assert _vals(fd.read_text_feed(spark, p)) == ["# kept", "a.com", "b.com"]


def test_gzip_feed(spark):
    p = _write("x.org\n#c\ny.org\n", "t.txt.gz", compress=True)
    assert _vals(fd.read_feed(spark, p, "text")) == ["x.org", "y.org"]


def test_hosts_feed(spark):
    p = _write("# c\n0.0.0.0 Evil.COM www.evil.com #tail x.net\n127.0.0.1\n\n1.2.3.4\tA.b\n", "hosts")
    assert _vals(fd.read_hosts_feed(spark, p)) == ["a.b", "evil.com", "www.evil.com", "x.net"]


def test_csv_feed(spark):
    p = _write("id,url,status\n1, http://a/x ,online\n2,#skip,online\n3,,online\n4\n5,http://b,ok\n", "f.csv")
    assert _vals(fd.read_csv_feed(spark, p, column=1, skip_header=True)) == ["http://a/x", "http://b"]
    assert "url" in _vals(fd.read_csv_feed(spark, p, column=1, skip_header=False))
    narrow = _write("# a comment\n1,x.org,ok\n2,\"y, z.org\",ok\n", "narrow.csv")
    assert _vals(fd.read_csv_feed(spark, narrow, column=1)) == ["x.org", "y, z.org"]
    short_header = _write("list\n1,x.org,ok\n2,y.org,ok\n", "short.csv")
    assert _vals(fd.read_csv_feed(spark, short_header, column=1, skip_header=True)) == ["x.org", "y.org"]


def test_json_feed(spark):
    p1 = _write(json.dumps(["a.com", " b.com ", "", None]), "l.json")
    p2 = _write(json.dumps({"meta": 1, "domains": ["c.com"], "urls": ["ignored"]}), "o.json")
    assert _vals(fd.read_json_feed(spark, p1)) == ["a.com", "b.com"]
    assert _vals(fd.read_json_feed(spark, p2)) == ["c.com"]


def _table(spark):
    rows = [("s1", "threat_domains", "a.com", "2025-12-31 00:00:00"), ("s1", "threat_domains", "b.com", "2025-12-01 00:00:00"),
            ("s2", "threat_domains", "b.com", "2025-12-31 12:00:00"), ("s3", "threat_ips", "1.2.3.4", None)]
    df = spark.createDataFrame(rows, "source string, category string, value string, t string")
    return df.select("source", "category", "value", F.to_timestamp("t").alias("added_at"))


def test_replace_additive_differential(spark):
    t = _table(spark)
    vals = spark.createDataFrame([("c.com",), ("a.com",)], "value string")
    now = F.to_timestamp(F.lit(NOW))
    rep = ind.snapshot_replace(t, "s1", "threat_domains", vals, now)
    assert sorted((r.source, r.value) for r in rep.collect()) == [
        ("s1", "a.com"), ("s1", "c.com"), ("s2", "b.com"), ("s3", "1.2.3.4")]
    add = ind.additive_merge(t, "s1", "threat_domains", vals, now)
    assert sorted(r.value for r in add.where("source = 's1'").collect()) == ["a.com", "b.com", "c.com"]
    ops = spark.createDataFrame([("+d.com",), ("-b.com",), ("plain.com",), ("+e.com",), ("-e.com",)], "value string")
    diff = ind.differential_merge(t, "s1", "threat_domains", ops, now)
    assert sorted(r.value for r in diff.where("source = 's1'").collect()) == ["a.com", "d.com"]
    plain = spark.createDataFrame([("z.com",)], "value string")
    assert ind.differential_merge(t, "s1", "threat_domains", plain, now).where("value = 'z.com'").count() == 1


def test_expiry_keeps_missing_timestamps(spark):
    t = _table(spark)
    now = F.to_timestamp(F.lit(NOW))
    out = ind.expire(t, "s1", 48, now)
    assert sorted(r.value for r in out.where("source = 's1'").collect()) == ["a.com"]
    assert ind.expire(t, "s3", 1, now).where("source = 's3'").count() == 1


def test_category_view_enable_disable_counts(spark):
    t = _table(spark)
    feeds = spark.createDataFrame([("s1", "threat_domains", "x", True, "healthy", 1),
                                   ("s2", "threat_domains", "x", True, "degraded", 1),
                                   ("s3", "threat_ips", "x", False, "healthy", 1)], ind.FEED_SCHEMA)
    v = ind.category_view(t, feeds)
    assert sorted((r.category, r.value) for r in v.collect()) == [("threat_domains", "a.com"), ("threat_domains", "b.com")]
    # disabling s1 keeps b.com (still held by s2), unlike a plain set subtraction
    v2 = ind.category_view(t, ind.set_enabled(feeds, "s1", False))
    assert [r.value for r in v2.collect()] == ["b.com"]
    assert {r.category: r["items"] for r in ind.category_counts(t, ind.set_enabled(feeds, "s3", True)).collect()} == {
        "threat_domains": 2, "threat_ips": 1}
    c = ind.source_counts(feeds).collect()[0]
    assert (c.total_sources, c.enabled_sources, c.healthy_sources) == (3, 2, 2)
    f2, t2 = ind.add_source(feeds, t, "custom", "threat_ips", spark.createDataFrame([("1.2.3.4",)], "value string"))
    assert ind.lookup(spark.createDataFrame([("1.2.3.4",)], "v string"), "v", "threat_ips",
                      ind.category_view(t2, f2, "threat_ips")).count() == 1
    f3, t3 = ind.remove_source(f2, t2, "custom")
    assert ind.category_view(t3, f3, "threat_ips").count() == 0


def joined_hash(items):
    return hashlib.md5("|".join(sorted(items)).encode()).hexdigest()


def bucket_digest(items):
    buckets = {}
    for i in items:
        buckets.setdefault(hashlib.md5(i.encode()).hexdigest()[:3], []).append(i)
    return hashlib.md5("|".join(f"{b}:{joined_hash(v)}" for b, v in sorted(buckets.items())).encode()).hexdigest()


def test_set_version(spark):
    t = _table(spark)
    h = joined_hash(["a.com", "b.com"])
    for rows in (t, t.unionAll(t)):
        got = {r.source: (r.version, r.hash, r.digest) for r in ind.set_version(rows, by=["source"]).collect()}
        assert got["s1"] == (f"1.2.{h[:6]}", h[:8], bucket_digest(["a.com", "b.com"]))
    fp = ind.set_fingerprint(t, by=["source"]).collect()
    assert len(fp) == 3


def test_set_version_of_large_and_empty_sets(spark):
    items = [f"host{i}.example" for i in range(5000)]
    rows = spark.createDataFrame([("big", i) for i in items] + [("small", "x"), ("none", None), (None, "y")], "source string, value string")
    got = {r.source: r for r in ind.set_version(rows, by=["source"], max_joined=100).collect()}
    digest = bucket_digest(items)
    assert got["big"].digest == digest and got["big"].version == f"1.5000.{digest[:6]}" and got["big"].hash == digest[:8]
    assert got["small"].hash == joined_hash(["x"])[:8] and got[None].hash == joined_hash(["y"])[:8] and "none" not in got
    assert ind.set_version(rows.where("source = 'big'")).first().hash == joined_hash(items)[:8]
    assert ind.set_version(rows.where("source = 'big'"), max_joined=10).first().hash == digest[:8]
    assert ind.set_version(rows.where("source = 'none'")).collect() == []


def test_lookups(spark):
    safe = builtin_indicators(spark).where("category = 'whitelist_domains'").select("value")
    vals = spark.createDataFrame([("google.com",), ("mail.google.com",), ("evil-api.malware.com",),
                                  ("totally-random-evil-site.xyz",), ("Mail.Google.com",)], "v string")
    assert sorted(r.v for r in ind.safe_domain_lookup(vals, "v", safe).collect()) == [
        "Mail.Google.com", "google.com", "mail.google.com"]
    ua = builtin_indicators(spark).where("category = 'suspicious_user_agents'").select("value")
    uas = spark.createDataFrame([("python-requests/2.28",), ("Mozilla/5.0",)], "v string")
    assert [r.v for r in ind.lookup(uas, "v", "suspicious_user_agents", ua).collect()] == ["python-requests/2.28"]
    kw = builtin_indicators(spark).where("category = 'phishing_keywords'").select("value")
    urls = spark.createDataFrame([("account-verify",), ("hello",)], "v string")
    assert [r.v for r in ind.substring_lookup(urls, "v", kw).collect()] == ["account-verify"]
    pre = spark.createDataFrame([("10.0.",), ("192.168.1.1",)], "value string")
    ips = spark.createDataFrame([("10.0.3.4",), ("192.168.1.10",), ("11.0.0.1",)], "v string")
    assert sorted(r.v for r in ind.prefix_lookup(ips, "v", pre).collect()) == ["10.0.3.4", "192.168.1.10"]
    assert default_safe_domains(spark).count() == 25


def test_substring_join(spark):
    from netsift.operators.joins import contains_any_join
    items = spark.createDataFrame([(f"tok{i:05d}",) for i in range(50)] + [("evil",), ("q",), ("vi",), ("tokyo",), ("",)], "value string")
    vals = spark.createDataFrame([("xxTOK00042yy",), ("an evil agent",), ("clean",), ("Q",), ("",), (None,)], "v string")
    got = {r.v: r.matched for r in contains_any_join(vals, "v", items).collect()}
    assert got == {"xxTOK00042yy": ["tok00042"], "an evil agent": ["evil", "vi"], "Q": ["q"]}


def test_cidr_and_url_matches(spark):
    from conftest import flows_df
    flows = flows_df(spark, [dict(src_ip="45.33.0.7", dst_ip="8.8.8.8"), dict(src_ip="10.0.0.1", dst_ip="1.2.3.4"),
                             dict(src_ip="10.0.0.1", dst_ip="11.1.255.255")])
    cidrs = spark.createDataFrame([("45.33.0.0/24",), ("1.2.3.4/32",), ("11.0.0.0/8",), ("bad",)], "value string")
    got = sorted((r.role, r.ip, r.cidr) for r in ind.threat_ip_matches(flows, cidrs).collect())
    assert got == [("dst", "1.2.3.4", "1.2.3.4/32"), ("dst", "11.1.255.255", "11.0.0.0/8"),
                   ("src", "45.33.0.7", "45.33.0.0/24")]
    urls = spark.createDataFrame([(1, "HTTP://Evil.COM/a/#frag"), (2, "http://ok.com/")], "page_id long, url string")
    t = spark.createDataFrame([("http://evil.com/a",)], "value string")
    assert [r.page_id for r in ind.threat_url_matches(urls, t).collect()] == [1]


def test_set_version_non_ascii_matches_python(spark):
    from netsift.sources.builtin import BUILTIN_PHISHING_KEYWORDS
    df = builtin_indicators(spark).where("category = 'phishing_keywords'").select("value")
    got = ind.set_version(df).collect()[0]
    items = set(BUILTIN_PHISHING_KEYWORDS)
    h = joined_hash(items)
    assert (got.version, got.hash) == (f"1.{len(items)}.{h[:6]}", h[:8])
