"""Indicator feed readers.

Each reader returns a one-column DataFrame ``value`` of distinct items. Text,
hosts and CSV feeds are read line-parallel (splittable unless compressed);
JSON feeds are whole documents, so one file is one task (feeds are split
into several files when large). Gzip is decompressed by the readers (S8).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
JSON_LIST_KEYS = ["items", "domains", "ips", "urls", "indicators"]
# ------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def read_text_feed(spark: SparkSession, path: str) -> DataFrame:
    """One item per line; blank lines and lines starting '#' are dropped.

    The '#' test is on the raw line (before stripping), as in the reference,
    so an indented '# x' line is kept as the item '# x'.
    """
    lines = spark.read.text(path)
    return (lines.where(~F.col("value").startswith("#"))
            .select(strip(F.col("value")).alias("value")).where(F.col("value") != "").distinct())


def read_hosts_feed(spark: SparkSession, path: str) -> DataFrame:
    """``IP name [name ...]`` lines; the IP is dropped, names lower-cased."""
    line = strip(F.col("value"))
    parts = F.split(line, r"\s+")
    rows = spark.read.text(path).select(line.alias("line"), parts.alias("parts")) \
        .where((F.col("line") != "") & ~F.col("line").startswith("#") & (F.size("parts") >= 2))
    names = rows.select(F.explode(F.slice("parts", 2, F.size("parts") - 1)).alias("n"))
    return (names.select(F.lower(strip(F.col("n"))).alias("value"))
            .where((F.col("value") != "") & ~F.col("value").startswith("#")).distinct())


def read_csv_feed(spark: SparkSession, path: str, column: int = 0, skip_header: bool = False) -> DataFrame:
    """Column ``column`` of a CSV feed, optionally skipping the first row
    of each file; values are stripped and blank / '#' values dropped. The
    schema is as wide as the column needs, so the width of the first line
    (a comment, a short header) decides nothing; shorter rows have no value."""
    schema = ", ".join(f"c{i} string" for i in range(column + 1))
    df = spark.read.schema(schema).option("header", str(bool(skip_header)).lower()).option("enforceSchema", "true") \
        .option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    v = strip(F.col(f"c{column}"))
    return df.select(v.alias("value")).where(F.col("value").isNotNull() & (F.col("value") != "")
                                             & ~F.col("value").startswith("#")).distinct()


def read_json_feed(spark: SparkSession, path: str) -> DataFrame:
    """A top-level JSON list, or the first of items/domains/ips/urls/indicators
    that holds a list. NULL and empty entries are skipped, the rest stripped
    (JSON numbers arrive as their text)."""
    doc = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", "array<string>")
    schema = "struct<" + ",".join(f"{k}:array<string>" for k in JSON_LIST_KEYS) + ">"
    as_obj = F.from_json("value", schema)
    items = F.coalesce(as_list, *[as_obj.getField(k) for k in JSON_LIST_KEYS])
    return (doc.select(F.explode(items).alias("item"))
            .where(F.col("item").isNotNull() & (F.col("item") != ""))
            .select(strip(F.col("item")).alias("value")).distinct())


def read_feed(spark: SparkSession, path: str, fmt: str = "text", column: int = 0,
              skip_header: bool = False) -> DataFrame:
    """Dispatch on the feed format (``text``, ``hosts``, ``csv``, ``json``).
    ``.gz`` files are read transparently (S8)."""
    if fmt == "text":
        return read_text_feed(spark, path)
    if fmt == "hosts":
        return read_hosts_feed(spark, path)
    if fmt == "csv":
        return read_csv_feed(spark, path, column, skip_header)
    if fmt == "json":
        return read_json_feed(spark, path)
    raise ValueError(f"unknown feed format {fmt!r}")
