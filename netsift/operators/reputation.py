"""Reputation tables: tiered cache (C1-C8), IP tiers and lookups (J6, J7,
D16, D18), domain triage (J8, J9, D17).

The reference keeps three JSON dictionaries and calls outside services per
item. Here the cache is a table ``reputation_cache(key, level, age_days,
abuse_score, isp)`` and the outside service is a snapshot table; every step is
a join over distinct keys, so the work is one shuffle of the distinct
endpoints (or a broadcast of the snapshot when its size is checked small).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions import domain as dom
from netsift.functions import ip as ipf
from netsift.operators import detectors as det
from netsift.operators.alerts import to_alerts
from netsift.operators.flows import distinct_values

# --- fixed values -------------------------------------------------------------
WHITELIST_SCORE = 0        # score that may qualify for the permanent tier
SAFE_BELOW = 10            # score < 10 → safe tier
THREAT_AT = 10             # score >= 10 → malicious tier
HIGH_AT = 50               # score >= 50 → HIGH severity, confidence 0.95
TTL_DAYS = {"whitelist": None, "safe": 30, "malicious": 90}
GET_ORDER = ["whitelist", "safe", "malicious"]          # C1 search order
TIER_ORDER = ["whitelist", "malicious", "safe"]         # J6 precedence
IP_CACHE_TTL_HOURS = 24                                 # C6
SAFE_DOMAIN_TTL_DAYS = 30                               # J9, C7
KNOWN_CLOUD_PROVIDERS = [
    "Google LLC", "Google Cloud", "Cloudflare, Inc.", "Cloudflare",
    "Amazon Technologies Inc.", "Amazon.com", "Microsoft Corporation", "Azure",
    "Akamai Technologies", "Fastly", "DigitalOcean, LLC",
]
SAFE_DOMAIN_KEYWORDS = [
    "google.com", "microsoft.com", "apple.com", "amazon.com",
    "github.com", "cloudflare.com",
    "baidu.com", "aliyun.com", "tencent.com", "qq.com",
    "netease.com", "sina.com.cn", "sohu.com", "jd.com",
    "huawei.com", "xiaomi.com", "bilibili.com", "douyin.com",
]
IP_ENGINE = "ip_reputation_detector"
DOMAIN_ENGINE = "domain_reputation_detector"
# ------------------------------------------------------------------------------


def is_cloud_isp(isp) -> Column:
    """the ISP text contains a known cloud-provider name."""
    isp = F.coalesce(F.col(isp) if isinstance(isp, str) else isp, F.lit(""))
    return reduce(lambda a, b: a | b, [F.instr(isp, p) > 0 for p in KNOWN_CLOUD_PROVIDERS])


def reputation_level(score: Column, isp) -> Column:
    """D16 tiers: permanent whitelist (score 0 and a cloud ISP), safe (< 10), malicious (>= 10).
    A missing score counts as 0, as in the reference."""
    score = F.coalesce(score, F.lit(0))
    return (F.when((score < SAFE_BELOW) & (score == WHITELIST_SCORE) & is_cloud_isp(isp), "whitelist")
            .when(score < SAFE_BELOW, "safe")
            .when(score >= THREAT_AT, "malicious"))


def cache_from_snapshot(rep: DataFrame, key: str = "ip") -> DataFrame:
    """Cache rows ``(key, level, age_days, abuse_score, isp)`` from a reputation snapshot."""
    return rep.select(F.col(key).alias("key"), reputation_level(F.col("abuse_score"), "isp").alias("level"),
                      "age_days", "abuse_score", "isp")


def is_live(level: Column, age_days: Column, ttl: dict = TTL_DAYS) -> Column:
    """an entry is live while floor(age in days) < TTL; no TTL → never expires."""
    c = F.lit(False)
    for lvl, t in ttl.items():
        c = F.when(level == lvl, F.lit(True) if t is None else (age_days < t)).otherwise(c)
    return c


def _rank(order: list[str]) -> Column:
    r = F.lit(len(order))
    for i, lvl in reversed(list(enumerate(order))):
        r = F.when(F.col("level") == lvl, i).otherwise(r)
    return r


def cache_get(cache: DataFrame, keys: DataFrame | None = None, level: str | None = None,
              order: list[str] = GET_ORDER, ttl: dict = TTL_DAYS) -> DataFrame:
    """First live entry per key (in ``order``, or only ``level``)."""
    c = cache.where(is_live(F.col("level"), F.col("age_days"), ttl))
    if level:
        c = c.where(F.col("level") == level)
    if keys is not None:
        c = c.join(keys.select("key").distinct(), "key", "left_semi")
    w = Window.partitionBy("key").orderBy(_rank(order), F.asc("age_days"))
    return c.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def cache_upsert(cache: DataFrame, updates: DataFrame) -> DataFrame:
    """Last write wins per (key, level); ``updates`` rows have age 0 (now)."""
    both = cache.withColumn("_src", F.lit(0)).unionByName(updates.withColumn("_src", F.lit(1)),
                                                          allowMissingColumns=True)
    w = Window.partitionBy("key", "level").orderBy(F.desc("_src"), F.asc("age_days"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_src")


def cache_remove(cache: DataFrame, keys: DataFrame, level: str | None = None) -> DataFrame:
    """Drop keys (from one level or all)."""
    hit = keys.select("key").distinct()
    if level is None:
        return cache.join(hit, "key", "left_anti")
    other = cache.where(F.col("level") != level)
    return other.unionByName(cache.where(F.col("level") == level).join(hit, "key", "left_anti"))


def cache_clear(cache: DataFrame, level: str | None = None) -> DataFrame:
    """Empty one level (or everything)."""
    return cache.where(F.lit(False)) if level is None else cache.where(F.col("level") != level)


def cache_expire(cache: DataFrame, ttl: dict = TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """C4: (kept entries, removed count per level). The whitelist never expires."""
    live = is_live(F.col("level"), F.col("age_days"), ttl)
    removed = cache.groupBy("level").agg(F.count(F.when(~live, 1)).alias("removed"))
    return cache.where(live), removed


def cache_stats(cache: DataFrame, lookups: DataFrame, ttl: dict = TTL_DAYS) -> DataFrame:
    """Hits, misses and hit rate of a batch of key lookups, and level sizes.

    ``lookups(key)`` holds one row per lookup (repeats count again). The two
    inputs are tagged and unioned so one aggregate yields the single row.
    """
    live = cache_get(cache, ttl=ttl).select("key", F.lit(True).alias("hit"))
    outcome = lookups.select("key").join(live, "key", "left") \
        .select(F.lit("lookup").alias("src"), F.col("hit"), F.lit(None).cast("string").alias("level"))
    sized = cache.select(F.lit("cache").alias("src"), F.lit(None).cast("boolean").alias("hit"), "level")
    u = outcome.unionByName(sized)
    lk = F.col("src") == "lookup"
    s = u.agg(F.count(F.when(lk & F.col("hit"), 1)).alias("hits"),
              F.count(F.when(lk & F.col("hit").isNull(), 1)).alias("misses"),
              *[F.count(F.when((F.col("src") == "cache") & (F.col("level") == lvl), 1)).alias(f"{lvl}_size")
                for lvl in GET_ORDER])
    return s.withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0,
                                           F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0))


def hour_cache_live(cache: DataFrame, age_hours: Column, ttl_hours: int = IP_CACHE_TTL_HOURS) -> DataFrame:
    """Entries whose age in hours is <= the TTL (default 24 h)."""
    return cache.where(age_hours <= ttl_hours)


def safe_days_left(cache: DataFrame, ttl_days: int = SAFE_DOMAIN_TTL_DAYS) -> DataFrame:
    """Safe entries with whole days left before expiry, only > 0."""
    return (cache.where(F.col("level") == "safe")
            .select("key", (F.lit(ttl_days) - F.col("age_days")).alias("days_left"))
            .where(F.col("days_left") > 0))


# --- IP reputation (J6, J7, D16, D18) ----------------------------------------------

def external_destinations(flows: DataFrame) -> DataFrame:
    """Distinct external destination IPs."""
    return distinct_values(flows, "dst_ip", "key").where(ipf.is_external_ip("key"))


def ip_tiers(flows: DataFrame, cache: DataFrame) -> DataFrame:
    """Live tier per external destination, whitelist > malicious > safe."""
    return cache_get(cache, external_destinations(flows), order=TIER_ORDER) \
        .select(F.col("key").alias("ip"), F.col("level").alias("tier"), "abuse_score", "isp", "age_days")


def pending_ips(flows: DataFrame, cache: DataFrame) -> DataFrame:
    """External destinations with no live tier (to be looked up)."""
    live = cache_get(cache, order=TIER_ORDER).select("key")
    return external_destinations(flows).join(live, "key", "left_anti").select(F.col("key").alias("ip"))


def ip_lookup(flows: DataFrame, cache: DataFrame, service: DataFrame) -> DataFrame:
    """J7 → service: classified results ``(ip, abuse_score, isp, level)`` for the
    pending IPs the service knows (the snapshot is broadcast after a size check)."""
    svc = service.select("ip", "abuse_score", "isp")
    return (pending_ips(flows, cache).join(svc, "ip")
            .select("ip", "abuse_score", "isp", reputation_level(F.col("abuse_score"), "isp").alias("level")))


def malicious_ips(flows: DataFrame, cache: DataFrame, service: DataFrame) -> DataFrame:
    """D16 findings: newly looked-up IPs in the malicious tier."""
    return (ip_lookup(flows, cache, service).where(F.col("level") == "malicious")
            .select("ip", "abuse_score", "isp",
                    F.when(F.col("abuse_score") >= HIGH_AT, "HIGH").otherwise("MEDIUM").alias("severity"),
                    F.when(F.col("abuse_score") >= HIGH_AT, 0.95).otherwise(0.7).alias("confidence")))


def malicious_ips_alerts(flows: DataFrame, cache: DataFrame, service: DataFrame) -> DataFrame:
    f = malicious_ips(flows, cache, service)
    return to_alerts(
        f, engine=IP_ENGINE, threat_type="MALICIOUS_IP", severity=F.col("severity"), confidence=F.col("confidence"),
        description=F.format_string("Reputation: %s (abuse score %d%%)", F.col("ip"), F.col("abuse_score")),
        evidence={"ip": F.col("ip"), "abuse_score": F.col("abuse_score"), "isp": F.col("isp")},
        ioc=[F.col("ip")], action="Block this IP or investigate further")


def malicious_ip_listing(flows: DataFrame, cache: DataFrame, service: DataFrame) -> DataFrame:
    """Every malicious-tier IP seen in traffic, from the cache or a new lookup."""
    cached = ip_tiers(flows, cache).where(F.col("tier") == "malicious") \
        .select("ip", "abuse_score", F.lit("cache").alias("origin"))
    new = malicious_ips(flows, cache, service).select("ip", "abuse_score", F.lit("lookup").alias("origin"))
    return cached.unionByName(new)


def new_cache_entries(flows: DataFrame, cache: DataFrame, service: DataFrame) -> DataFrame:
    """C2 input: looked-up IPs as cache rows with age 0."""
    return ip_lookup(flows, cache, service).select(
        F.col("ip").alias("key"), "level", F.lit(0).alias("age_days"), "abuse_score", "isp")


def lookup_stats(flows: DataFrame, cache: DataFrame, service: DataFrame) -> DataFrame:
    """List sizes, lookups made and cache hits of one run (one aggregate
    over the tagged union of the three inputs)."""
    tiers = ip_tiers(flows, cache).select(F.lit("hit").alias("src"), F.lit(None).cast("string").alias("level"))
    looked = ip_lookup(flows, cache, service).select(F.lit("query").alias("src"),
                                                     F.lit(None).cast("string").alias("level"))
    sized = cache.select(F.lit("cache").alias("src"), "level")
    u = sized.unionByName(tiers).unionByName(looked)
    src = F.col("src")
    return u.agg(*[F.count(F.when((src == "cache") & (F.col("level") == lvl), 1)).alias(f"{lvl}_size")
                   for lvl in GET_ORDER],
                 F.count(F.when(src == "query", 1)).alias("api_queries"),
                 F.count(F.when(src == "hit", 1)).alias("cache_hits"))


# --- domain triage (U2, J8, J9, D17) -----------------------------------------------

def candidate_domains(flows: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Flagged names ∪ all DNS names, normalised (lower, trailing dots), distinct."""
    names = det.dns_flows(flows).where(F.col("requested_server_name").isNotNull()) \
        .select(dom.normalize("requested_server_name").alias("domain"))
    if flagged is not None:
        names = names.unionByName(flagged.select(dom.normalize("domain").alias("domain")))
    return distinct_values(names, "domain", "domain")


def gate_domains(candidates: DataFrame, whitelist: DataFrame | None = None,
                 safe_cache: DataFrame | None = None, ttl_days: int = SAFE_DOMAIN_TTL_DAYS) -> DataFrame:
    """Not under a known-safe suffix, not whitelisted, not in the live safe
    list, and suspicious by the rule check (M7)."""
    spark = candidates.sparkSession
    safe = spark.createDataFrame([(d,) for d in SAFE_DOMAIN_KEYWORDS], "matched string")
    sfx = candidates.select("domain", F.explode(dom.suffixes("domain")).alias("matched"))
    under_safe = sfx.join(F.broadcast(safe), "matched").select("domain")  # 18 fixed literals
    g = candidates.join(under_safe, "domain", "left_anti")
    if whitelist is not None:
        g = g.join(whitelist.select(F.col("key").alias("domain")), "domain", "left_anti")
    if safe_cache is not None:
        g = g.join(safe_cache.where(F.col("age_days") < ttl_days).select(F.col("key").alias("domain")),
                   "domain", "left_anti")
    return g.where(dom.rule_suspicious("domain"))


def triage_domains(flows: DataFrame, reputation: DataFrame, flagged: DataFrame | None = None,
                   whitelist: DataFrame | None = None, safe_cache: DataFrame | None = None) -> DataFrame:
    """Gated candidates joined with the domain-reputation snapshot, with an
    ``outcome`` of whitelist / safe / threat."""
    gated = gate_domains(candidate_domains(flows, flagged), whitelist, safe_cache)
    rep = reputation.select(dom.normalize("domain").alias("domain"), "severity", "judgment", "is_malicious")
    j = gated.join(rep, "domain")
    is_susp = F.col("severity") == "suspicious"
    return j.select("domain", "severity", "judgment", "is_malicious", is_susp.alias("is_suspicious"),
                    F.when(F.col("judgment") == "Whitelist", "whitelist")
                    .when(~F.col("is_malicious") & ~is_susp, "safe")
                    .otherwise("threat").alias("outcome"))


def domain_threats(flows: DataFrame, reputation: DataFrame, **kw) -> DataFrame:
    """D17 findings: threat outcomes with A9 statistics on the normalised name."""
    t = triage_domains(flows, reputation, **kw).where(F.col("outcome") == "threat")
    dns = det.dns_flows(flows)
    stats = det.domain_query_stats(dns, t, key=dom.normalize("requested_server_name"))
    return (t.join(stats, "domain", "left")
            .select("domain", "severity", "judgment",
                    F.when(F.col("is_malicious"), "HIGH").otherwise("MEDIUM").alias("alert_severity"),
                    F.when(F.col("is_malicious"), 0.95).otherwise(0.7).alias("confidence"),
                    F.coalesce("query_count", F.lit(0)).alias("query_count"),
                    F.coalesce("source_ips", F.lit("")).alias("source_ips")))


def domain_threats_alerts(flows: DataFrame, reputation: DataFrame, **kw) -> DataFrame:
    f = domain_threats(flows, reputation, **kw)
    return to_alerts(
        f, engine=DOMAIN_ENGINE, threat_type="PHISHING", severity=F.col("alert_severity"),
        confidence=F.col("confidence"),
        description=F.format_string("Domain reputation: %s (severity %s, judgment %s)",
                                    F.col("domain"), F.col("severity"), F.col("judgment")),
        evidence={"domain": F.col("domain"), "severity": F.col("severity"), "judgments": F.col("judgment"),
                  "query_count": F.col("query_count"), "source_ips": F.col("source_ips")},
        ioc=[F.col("domain")], action="Isolate the hosts that resolved this domain")
