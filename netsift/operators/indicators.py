"""Indicator tables and lookups.

State lives in two tables:

- ``indicators(source, category, value, added_at)``: one row per item per
  source (Parquet, partitioned by source, see ``sources.sinks``);
- ``feeds(source, category, source_type, enabled, health, expiry_hours)``:
  the small feed catalog.

Updates are DataFrame transformations of the current ``indicators`` table:
only the rows of one source change, and the category view (I5) is recomputed
as a union over the enabled sources instead of the reference's set
subtraction (which removed values another source still held).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions import domain as dom
from netsift.operators import joins as jn

INDICATOR_SCHEMA = "source string, category string, value string, added_at timestamp"
FEED_SCHEMA = "source string, category string, source_type string, enabled boolean, health string, expiry_hours int"


def _rows(source: str, category: str, values: DataFrame, now: Column) -> DataFrame:
    return values.select(F.lit(source).alias("source"), F.lit(category).alias("category"),
                         F.col("value"), now.cast("timestamp").alias("added_at"))


def _now(now) -> Column:
    return F.current_timestamp() if now is None else (now if isinstance(now, Column) else F.lit(now))


def snapshot_replace(indicators: DataFrame, source: str, category: str, values: DataFrame,
                     now=None) -> DataFrame:
    """The source's items become ``values``, all stamped ``now``."""
    keep = indicators.where(F.col("source") != source)
    return keep.unionByName(_rows(source, category, values.select("value").distinct(), _now(now)))


def additive_merge(indicators: DataFrame, source: str, category: str, values: DataFrame,
                   now=None) -> DataFrame:
    """Add only values the source does not hold yet, stamped ``now``."""
    mine = indicators.where(F.col("source") == source).select("value")
    new = values.select("value").distinct().join(mine, "value", "left_anti")
    return indicators.unionByName(_rows(source, category, new, _now(now)))


def differential_merge(indicators: DataFrame, source: str, category: str, ops: DataFrame,
                       now=None) -> DataFrame:
    """Items prefixed '+' are added (re-stamped), '-' removed; unprefixed
    items are ignored. Without any prefixed item the update is additive (I2).

    The reference applies the operations in set order; when a value has both
    '+' and '-', removal wins here (deterministic).
    """
    o = ops.select(F.col("value").alias("op")).where(F.col("op").isNotNull() & (F.col("op") != ""))
    signed = o.where(F.col("op").startswith("+") | F.col("op").startswith("-"))
    if signed.limit(1).count() == 0:
        return additive_merge(indicators, source, category, o.select(F.col("op").alias("value")), now)
    adds = signed.where(F.col("op").startswith("+")).select(F.expr("substring(op, 2)").alias("value")).distinct()
    rems = signed.where(F.col("op").startswith("-")).select(F.expr("substring(op, 2)").alias("value")).distinct()
    adds = adds.join(rems, "value", "left_anti")
    mine = indicators.where(F.col("source") == source)
    others = indicators.where(F.col("source") != source)
    kept = mine.join(rems.unionByName(adds).distinct(), "value", "left_anti").select(*mine.columns)
    return others.unionByName(kept).unionByName(_rows(source, category, adds, _now(now)))


def expire(indicators: DataFrame, source: str, expiry_hours: int, now=None) -> DataFrame:
    """I4: drop the source's items added more than ``expiry_hours`` before now;
    rows without a usable timestamp are kept."""
    cutoff = _now(now) - F.make_interval(hours=F.lit(expiry_hours))
    stale = (F.col("source") == source) & F.col("added_at").isNotNull() & (F.col("added_at") < cutoff)
    return indicators.where(~stale)


def category_view(indicators: DataFrame, feeds: DataFrame, category: str | None = None) -> DataFrame:
    """Distinct ``(category, value)`` over the enabled sources."""
    enabled = feeds.where(F.col("enabled")).select("source")
    v = indicators.join(enabled, "source", "left_semi")
    if category:
        v = v.where(F.col("category") == category)
    return v.select("category", "value").distinct()


def set_enabled(feeds: DataFrame, source: str, enabled: bool) -> DataFrame:
    """Enable / disable a source (the view recomputes)."""
    return feeds.withColumn("enabled", F.when(F.col("source") == source, F.lit(enabled))
                            .otherwise(F.col("enabled")))


def add_source(feeds: DataFrame, indicators: DataFrame, source: str, category: str, values: DataFrame,
               source_type: str = "local_file", expiry_hours: int = 168, now=None) -> tuple[DataFrame, DataFrame]:
    """Register a source (replacing one of the same name) with its items."""
    spark = feeds.sparkSession
    row = spark.createDataFrame([(source, category, source_type, True, "healthy", expiry_hours)], FEED_SCHEMA)
    return (feeds.where(F.col("source") != source).unionByName(row),
            snapshot_replace(indicators, source, category, values, now))


def remove_source(feeds: DataFrame, indicators: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Drop a source and its items."""
    return feeds.where(F.col("source") != source), indicators.where(F.col("source") != source)


def category_counts(indicators: DataFrame, feeds: DataFrame) -> DataFrame:
    """Distinct items per category after the merge."""
    return category_view(indicators, feeds).groupBy("category").agg(F.count(F.lit(1)).alias("items"))


def source_counts(feeds: DataFrame) -> DataFrame:
    """Sources total / enabled / healthy."""
    return feeds.agg(F.count(F.lit(1)).alias("total_sources"),
                     F.count(F.when(F.col("enabled"), 1)).alias("enabled_sources"),
                     F.count(F.when(F.col("health") == "healthy", 1)).alias("healthy_sources"))


def set_fingerprint(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F11 at scale: an order-free change fingerprint (count and XOR of 64-bit
    hashes) that merges across partitions, for change detection."""
    g = values.groupBy(*(by or []))
    return g.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("value")).alias("fingerprint"))


#: Items of a source up to which its version is the md5 of all items joined (the documented limit of a source).
MAX_JOINED_ITEMS = 1_000_000
DIGEST_PREFIX = 3  # hex digits: 4,096 buckets


def set_version(values: DataFrame, by: list[str] | None = None, max_joined: int = MAX_JOINED_ITEMS) -> DataFrame:
    """``(n, version, hash, digest)`` of the distinct non-null values, per ``by`` group.

    ``hash``: first 8 digits of the md5 of the sorted items joined by a bar;
    ``version``: ``1.<n>.<its first 6>``. That needs a group's items in one
    place, so beyond ``max_joined`` items both are taken from the digest.

    ``digest``: the md5 over 4,096 buckets of items (by their own md5) in order,
    each with the md5 of its sorted items. No task holds more than a bucket, and
    it depends on the set alone.
    """
    by = by or []
    items = values.select(*by, "value").where(F.col("value").isNotNull()).distinct()
    joined = F.md5(F.concat_ws("|", F.sort_array(F.collect_list("value"))))
    buckets = items.groupBy(*by, F.substring(F.md5("value"), 1, DIGEST_PREFIX).alias("_b")) \
        .agg(F.count(F.lit(1)).alias("_n"), joined.alias("_h"))
    named = F.sort_array(F.collect_list(F.concat("_b", F.lit(":"), F.col("_h"))))
    groups = buckets.groupBy(*by).agg(F.sum("_n").alias("n"), F.md5(F.concat_ws("|", named)).alias("digest"))
    small = groups.where(F.col("n") <= max_joined).select(*by)
    same = F.lit(True)
    for c in by:
        same &= items[c].eqNullSafe(small[c])
    if by:
        exact = items.join(small, same, "left_semi").groupBy(*by).agg(joined.alias("_m"))
        same = F.lit(True)
        for c in by:
            same &= groups[c].eqNullSafe(exact[c])
        out = groups.join(exact, same, "left").select(*[groups[c] for c in by], "n", "digest", "_m")
    else:
        (size,) = groups.select("n").collect() or [(0,)]
        exact = items.groupBy().agg(joined.alias("_m")) if (size[0] or 0) <= max_joined else \
            items.sparkSession.range(1).select(F.lit(None).cast("string").alias("_m"))
        out = groups.where("n > 0").crossJoin(exact)  # one row each
    h = F.coalesce("_m", "digest")
    return out.select(*by, "n", F.concat(F.lit("1."), F.col("n").cast("string"), F.lit("."), F.substring(h, 1, 6)).alias("version"),
                      F.substring(h, 1, 8).alias("hash"), "digest")


# --- lookups ---------------------------------------------------------------------

def exact_lookup(values: DataFrame, col: str, items: DataFrame) -> DataFrame:
    """Rows whose ``col`` is in the item set (case-sensitive)."""
    it = items.select(F.col("value").alias(col)).distinct()
    return values.join(it, col, "left_semi")


def safe_domain_lookup(values: DataFrame, col: str, items: DataFrame, anti: bool = False) -> DataFrame:
    """Exact match, or the lower-cased value equals an item or ends with
    '.' + item. Distinct values are exploded into label suffixes and
    equi-joined with the items; the rows are then semi- (or anti-) joined on
    the matched values."""
    it = items.select(F.col("value").alias("_m")).distinct()
    d = values.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    cand = d.select("_v", F.explode(F.array_union(F.array(F.col("_v")), dom.suffixes(F.lower(F.col("_v"))))).alias("_m"))
    hit = cand.join(it, "_m").select(F.col("_v").alias(col)).distinct()
    return values.join(hit, col, "left_anti" if anti else "left_semi")


def prefix_lookup(values: DataFrame, col: str, items: DataFrame) -> DataFrame:
    """Rows whose ``col`` starts with some item. Every prefix of a distinct
    value is exploded, so the match is an equi-join."""
    it = items.select(F.col("value").alias("_p")).where(F.col("_p") != "").distinct()
    d = values.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    cand = d.select("_v", F.explode(jn.prefixes(F.col("_v"))).alias("_p"))
    hit = cand.join(it, "_p").select(F.col("_v").alias(col)).distinct()
    return values.join(hit, col, "left_semi")


def substring_lookup(values: DataFrame, col: str, items: DataFrame) -> DataFrame:
    """Rows whose lower-cased ``col`` contains some item; adds ``matched``."""
    return jn.contains_any_join(values, col, items)


def lookup(values: DataFrame, col: str, category: str, items: DataFrame) -> DataFrame:
    """The reference's ``lookup`` per category: exact for all categories, plus
    suffix for whitelisted domains, prefix for whitelisted IPs and substring
    for user agents and phishing keywords."""
    if category == "whitelist_domains":
        return safe_domain_lookup(values, col, items)
    if category == "whitelist_ips":
        ex = exact_lookup(values, col, items)
        return ex.unionByName(prefix_lookup(values, col, items)).distinct()
    if category in ("suspicious_user_agents", "phishing_keywords"):
        sub = substring_lookup(values, col, items).drop("matched")
        return sub.unionByName(exact_lookup(values, col, items)).distinct()
    return exact_lookup(values, col, items)


def threat_ip_matches(flows: DataFrame, cidrs: DataFrame) -> DataFrame:
    """J12 [EXT]: flows whose source or destination lies in a threat CIDR;
    ``(role, ip, cidr, flows)``.

    One scan explodes both endpoints, flows are pre-aggregated per
    (role, ip) before the range join (bucketed equi-join + range predicate),
    so only distinct endpoints meet the CIDR table.
    """
    ends = flows.select(F.explode(F.array(
        F.struct(F.lit("src").alias("role"), F.col("src_ip").alias("ip")),
        F.struct(F.lit("dst").alias("role"), F.col("dst_ip").alias("ip")))).alias("e")).select("e.role", "e.ip")
    per_ip = ends.where(F.col("ip").isNotNull()).groupBy("role", "ip").agg(F.count(F.lit(1)).alias("flows"))
    return (jn.match_cidr(per_ip, "ip", cidrs).groupBy("role", "ip", "cidr")
            .agg(F.sum("flows").alias("flows")))


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, drop the fragment and a trailing '/'."""
    c = F.regexp_replace(strip_ws(c), "#.*$", "")
    scheme_host = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substring(c, F.length(scheme_host) + 1, 1 << 30)
    return F.regexp_replace(F.concat(F.lower(scheme_host), rest), "/+$", "")


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def threat_url_matches(urls: DataFrame, threat_urls: DataFrame, col: str = "url") -> DataFrame:
    """J13 [EXT]: URLs present in the threat-URL set after normalisation."""
    t = threat_urls.select(normalize_url(F.col("value")).alias("_n")).distinct()
    return (urls.withColumn("_n", normalize_url(F.col(col)))
            .join(t, "_n", "left_semi").drop("_n"))
