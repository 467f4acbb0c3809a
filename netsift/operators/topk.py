"""Exact top-k per group that survives a hot group.

``row_number() <= k`` over ``partitionBy(group)`` sends every row of a group
to one task before the cut (Spark adds a partial WindowGroupLimit only when a
shuffle separates it from the window). Here the cut is taken twice: first
per (group, salt) with the salt a hash of the ordering columns, then per
group over at most ``k × salts`` survivors. The global top-k of a group is
contained in the union of its per-salt top-k, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 64


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    salt_cols: list[str] | None = None, salts: int = DEFAULT_SALTS,
                    rank_col: str | None = None) -> DataFrame:
    """Rows of ``df`` ranked ``<= k`` in ``order`` within ``group``.

    ``salt_cols`` (default: every non-group column) feed the salt hash; rows
    equal on them share a salt, which keeps duplicates together.
    """
    cols = salt_cols or [c for c in df.columns if c not in group]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salts)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group).orderBy(*order)
    name = rank_col or "_r2"
    out = stage1.withColumn(name, F.row_number().over(w2).cast("bigint")).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)
