"""Sinks: feed landing files, the JSON result (S11), the indicator snapshot
(S12) and models (S13). Every path is on shared storage (the session's
checkpoint folder by default, see ``session.scratch_dir``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.schema import ALERT_COLUMNS


# --- feed landing ------------------------------------------------------------------

def write_lines(lines: DataFrame, path: str, compression: str | None = None) -> str:
    """Write a one-column ``line`` frame as a text feed (optionally gzip, S8)."""
    w = lines.select(F.col("line").alias("value")).write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.text(path)
    return path


def write_csv(rows: DataFrame, path: str, header: bool = True) -> str:
    rows.write.mode("overwrite").option("header", str(header).lower()).csv(path)
    return path


def write_json_documents(values: DataFrame, path: str, key: str = "domains",
                         max_items_per_document: int = 50_000) -> str:
    """Land ``values(value)`` as JSON feed documents ``{"<key>": [...]}``, one
    document per file; the number of hash buckets grows with the item count so
    each document (and the task that builds it) stays bounded."""
    n = values.count()
    buckets = max(1, -(-n // max_items_per_document) * 2)
    b = F.pmod(F.xxhash64("value"), F.lit(buckets)).alias("bucket")
    docs = (values.select(b, "value").groupBy("bucket")
            .agg(F.to_json(F.struct(F.array_sort(F.collect_list("value")).alias(key))).alias("value")))
    docs.repartition("bucket").write.mode("overwrite").partitionBy("bucket").text(path)
    return path


# --- S11: JSON result ----------------------------------------------------------------

def write_result_json(path: str, summary: DataFrame, alerts: DataFrame, malicious_ips: DataFrame,
                      max_findings: int = 100, max_ips: int = 50) -> str:
    """Summary row, the first ``max_findings`` alerts and the first
    ``max_ips`` malicious IPs, each as a JSON-lines folder under ``path``.

    The cuts are the report's (W5), taken under a total order."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    order = [c for c in ("priority",) if c in alerts.columns] + ["engine_name", "threat_type", "severity",
                                                                 "description"]
    (alerts.orderBy(*order).limit(max_findings)
     .select(F.col("threat_type").alias("type"), "severity", "description", "evidence",
             F.col("recommended_action").alias("recommendation"))
     .write.mode("overwrite").json(f"{path}/findings"))
    malicious_ips.orderBy("ip").limit(max_ips).write.mode("overwrite").json(f"{path}/malicious_ips")
    return path


def result_document(summary: DataFrame) -> DataFrame:
    """one JSON text per summary row."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("json"))


def write_alerts(alerts: DataFrame, path: str) -> str:
    alerts.select(*ALERT_COLUMNS).write.mode("overwrite").parquet(path)
    return path


# --- S12: indicator snapshot --------------------------------------------------------

def write_indicators(indicators: DataFrame, path: str, sources: list[str] | None = None) -> str:
    """Persist the items partitioned by source. With ``sources`` only
    those partitions are replaced (dynamic partition overwrite)."""
    if sources is not None:
        indicators = indicators.where(F.col("source").isin(*sources))
    mode = "static" if sources is None else "dynamic"
    indicators.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("source").parquet(path)
    return path


def read_indicators(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """Read the snapshot back; a source filter prunes partitions."""
    df = spark.read.parquet(path)
    if sources is not None:
        df = df.where(F.col("source").isin(*sources))
    return df.select("source", "category", "value", "added_at")


def write_feeds(feeds: DataFrame, path: str) -> str:
    feeds.coalesce(1).write.mode("overwrite").parquet(path)
    return path


# --- S13: models ---------------------------------------------------------------------

def save_model(model, path: str) -> str:
    """A fitted ``pyspark.ml`` model or pipeline."""
    model.write().overwrite().save(path)
    return path


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
