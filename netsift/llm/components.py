"""Connected components by contraction: every round each node joins its smallest neighbour.

Only aggregates and equi-joins on unique keys, so a hub with very many links
is combined on the map side or split by the adaptive skew join. A round at
least halves the nodes of each unfinished component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b", folder: str | None = None) -> DataFrame:
    """(node, root) for every node of ``links``; nodes of one component share the root. Steps go to ``folder``."""
    edges = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links", folder=folder)
    mapping = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")) \
            .select("node", F.least("node", "low").alias("up"))
        jump = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = stored(step.join(jump, "up").select("node", F.col("top").alias("up")), "parents", folder=folder)
        if mapping is None:
            mapping = step.select("node", F.col("up").alias("root"))
        else:
            mapping = mapping.join(step.withColumnRenamed("node", "root"), "root", "left") \
                .select("node", F.coalesce("up", "root").alias("root"))
        mapping = stored(mapping, "roots", folder=folder)
        left, right = step.toDF("a", "ra"), step.toDF("b", "rb")
        edges = stored(edges.join(left, "a").join(right, "b").filter("ra <> rb")
                       .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links", folder=folder)
    if mapping is None:
        mapping = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping
