"""Join helpers: prefix / substring / CIDR joins.

All matches are equi-joins on keys cut from the values. No side is hinted:
Spark broadcasts a side only within its own size threshold, at planning time
or by the measured size under AQE, and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions import ip as ipf

def prefixes(c: Column) -> Column:
    """All non-empty prefixes of a string, so ``value.startswith(item)`` becomes an equi-join."""
    n = F.length(c)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: c.substr(F.lit(1), i))) \
        .otherwise(F.array().cast("array<string>"))


#: Characters of an item that serve as its join key.
ANCHOR = 3


def anchors(c: Column) -> Column:
    """The distinct substrings of 1 to ``ANCHOR`` characters."""
    n = F.length(c)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(
        at, lambda i: F.array(*[F.substr(c, i, F.lit(k)) for k in range(1, ANCHOR + 1)]))))


def contains_any_join(values: DataFrame, value_col: str, items: DataFrame, item_col: str = "value") -> DataFrame:
    """Rows of ``values`` whose lower-cased ``value_col`` contains some item.

    An item's first characters must occur in the value: distinct values and
    items meet on that key and are then compared, whatever the number of items.
    Returns ``values`` plus ``matched`` (array of matched items, sorted).
    """
    low_items = items.select(F.lower(F.col(item_col)).alias("item")).where(F.col("item") != "").distinct() \
        .withColumn("_a", F.substring("item", 1, ANCHOR))
    d = values.select(F.col(value_col).alias("_v")).where(F.col("_v").isNotNull()).distinct() \
        .withColumn("_low", F.lower(F.col("_v")))
    keyed = d.select("_v", "_low", F.explode_outer(anchors(F.col("_low"))).alias("_a"))
    hit = (keyed.join(low_items, "_a").where(F.instr(F.col("_low"), F.col("item")) > 0).groupBy("_v")
           .agg(F.array_sort(F.collect_set("item")).alias("matched")).withColumnRenamed("_v", "_hit"))
    return values.join(hit, F.col(value_col) == F.col("_hit")).drop("_hit")


def cidr_table(cidrs: DataFrame, value_col: str = "value", bucket_bits: int = 16) -> DataFrame:
    """CIDR text → (cidr, start, end, bucket) rows, one per /``bucket_bits``
    block the range covers (a /8 covers 256 blocks, a /24 one)."""
    start, end, plen = ipf.cidr_bounds(F.col(value_col))
    t = cidrs.select(F.col(value_col).alias("cidr"), start.alias("start"), end.alias("end")) \
        .where(F.col("start").isNotNull())
    shift = 32 - bucket_bits
    return t.select("*", F.explode(F.sequence(F.shiftright("start", shift), F.shiftright("end", shift))).alias("bucket"))


def match_cidr(df: DataFrame, ip_col: str, cidrs: DataFrame, bucket_bits: int = 16) -> DataFrame:
    """J12 building block: rows of ``df`` with an IPv4 ``ip_col`` inside a CIDR.

    Range join as equi-join on the /16 bucket plus a range predicate; adds
    ``cidr`` (one row per matching block).
    """
    ranges = cidr_table(cidrs, bucket_bits=bucket_bits)
    v = ipf.ipv4_to_long(ip_col)
    keyed = df.withColumn("_ipv", v).where(F.col("_ipv").isNotNull()) \
        .withColumn("_bucket", F.shiftright("_ipv", 32 - bucket_bits))
    r = ranges.withColumnRenamed("bucket", "_bucket")
    return (keyed.join(r, (keyed["_bucket"] == r["_bucket"]) & keyed["_ipv"].between(r["start"], r["end"]))
            .drop(r["_bucket"]))
