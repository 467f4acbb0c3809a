"""Exact quantiles without a single-task merge.

Spark's exact ``percentile`` keeps a value→count map per group and merges all
of them in one task for a global aggregate, which does not survive a
billion distinct byte counts. ``exact_quantiles`` selects the k-th values in
three distributed passes instead:

1. value histogram ``(name, value, count)`` (partial aggregation, skew-safe);
2. ``repartitionByRange`` of the histogram and per-range count/min/max
   (a few hundred scalars reach the driver);
3. for each wanted rank, only the histogram rows of the one range that holds
   it are re-read and a running sum picks the value.

The result is the linear-interpolation quantile (pandas / numpy default,
DuckDB ``quantile_cont``). ``method="approx"`` uses ``percentile_approx``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stack(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in cols.items()])
    return df.select(F.explode(arr).alias("x")).select("x.name", "x.value").where(F.col("value").isNotNull()
                                                                                  & ~F.isnan("value"))


def exact_quantiles(df: DataFrame, cols: dict[str, Column], q: float,
                    partitions: int | None = None) -> dict[str, float | None]:
    """Linear-interpolation quantile ``q`` of each column in ``cols`` (NULL/NaN skipped)."""
    if not cols:
        return {}
    spark = df.sparkSession
    hist = _stack(df, cols).groupBy("name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    hist = hist.persist()
    try:
        parts = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
        ranged = hist.repartitionByRange(parts, "name", "value")
        stats = (ranged.groupBy(F.spark_partition_id().alias("pid"), "name")
                 .agg(F.sum("cnt").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
                 .collect())
        by_name: dict[str, list] = {}
        for r in stats:
            by_name.setdefault(r["name"], []).append(r)
        wanted = []  # (name, rank, lo, hi, offset)
        plan: dict[str, tuple] = {}
        for name in cols:
            rows = sorted(by_name.get(name, []), key=lambda r: r["lo"])
            total = sum(r["n"] for r in rows)
            if total == 0:
                plan[name] = None
                continue
            pos = q * (total - 1)
            k0, k1 = math.floor(pos), math.ceil(pos)
            plan[name] = (k0, k1, pos - k0)
            for k in {k0, k1}:
                acc = 0
                for r in rows:
                    if acc + r["n"] > k:
                        wanted.append((name, k, r["lo"], r["hi"], acc))
                        break
                    acc += r["n"]
        values: dict[tuple, float] = {}
        if wanted:
            cond = None
            for name, k, lo, hi, off in wanted:
                c = (F.col("name") == name) & F.col("value").between(lo, hi)
                cond = c if cond is None else cond | c
            sub = hist.where(cond)
            tag = F.lit(None).cast("string")
            for name, k, lo, hi, off in wanted:
                tag = F.when((F.col("name") == name) & F.col("value").between(lo, hi),
                             F.lit(f"{name}|{lo!r}|{hi!r}")).otherwise(tag)
            w = Window.partitionBy("seg").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
            ranked = sub.withColumn("seg", tag).withColumn("cum", F.sum("cnt").over(w))
            keys = []
            for name, k, lo, hi, off in wanted:
                seg = f"{name}|{lo!r}|{hi!r}"
                local = k - off  # 0-based rank inside the range
                c = ((F.col("seg") == seg) & (F.col("cum") > local) & (F.col("cum") - F.col("cnt") <= local))
                keys.append(F.when(c, F.lit(f"{name}|{k}")))
            hits = ranked.select(F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull())).alias("key"), "value")
            for r in hits.collect():
                n, k = r["key"].rsplit("|", 1)
                values[(n, int(k))] = r["value"]
        out: dict[str, float | None] = {}
        for name in cols:
            p = plan[name]
            if p is None:
                out[name] = None
                continue
            k0, k1, frac = p
            v0, v1 = values[(name, k0)], values[(name, k1)]
            out[name] = v0 + (v1 - v0) * frac if k1 != k0 else v0
        return out
    finally:
        hist.unpersist()


def approx_quantiles(df: DataFrame, cols: dict[str, Column], q: float,
                     accuracy: int = 10000) -> dict[str, float | None]:
    if not cols:
        return {}
    row = df.agg(*[F.percentile_approx(c.cast("double"), q, accuracy).alias(n) for n, c in cols.items()]).first()
    return {n: (None if row[n] is None else float(row[n])) for n in cols}


def quantiles(df: DataFrame, cols: dict[str, Column], q: float, method: str = "exact") -> dict[str, float | None]:
    if method == "approx":
        return approx_quantiles(df, cols, q)
    return exact_quantiles(df, cols, q)
