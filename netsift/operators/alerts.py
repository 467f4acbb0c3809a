"""Alert construction and alert-table queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.schema import ALERT_COLUMNS, ALERT_SCHEMA


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def ioc_array(*cols: Column) -> Column:
    """Array of the non-NULL values as strings (concat of one-element arrays:
    code-generated, no higher-order function on the row path)."""
    empty = F.array().cast("array<string>")
    if not cols:
        return empty
    parts = [F.when(c.isNotNull(), F.array(c.cast("string"))).otherwise(empty) for c in cols]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def to_alerts(findings: DataFrame, *, engine: str, threat_type, severity, confidence,
              description: Column, evidence: dict[str, Column], ioc: list[Column],
              mitre=None, action: str | None = None) -> DataFrame:
    """Project a detector's flat findings onto ALERT_SCHEMA.

    ``evidence`` values are stringified (the reference's evidence is a free
    dict); NULL IOC entries are dropped.
    """
    ev = F.create_map(*[x for k, v in evidence.items() for x in (F.lit(k), _lit(v).cast("string"))])
    iocs = ioc_array(*[_lit(c) for c in ioc])
    return findings.select(
        F.lit(engine).alias("engine_name"),
        _lit(threat_type).cast("string").alias("threat_type"),
        _lit(severity).cast("string").alias("severity"),
        _lit(description).cast("string").alias("description"),
        ev.alias("evidence"),
        _lit(confidence).cast("double").alias("confidence"),
        iocs.alias("ioc"),
        _lit(mitre).cast("string").alias("mitre_technique"),
        _lit(action).cast("string").alias("recommended_action"),
    )


def empty_alerts(spark) -> DataFrame:
    return spark.createDataFrame([], ALERT_SCHEMA)


def union_alerts(frames: list[DataFrame], priorities: list[int] | None = None) -> DataFrame:
    """Concatenate alert frames; keep the detector priority as a column."""
    if priorities is not None:
        frames = [f.select(*ALERT_COLUMNS, F.lit(p).alias("priority")) for f, p in zip(frames, priorities)]
    else:
        frames = [f.select(*ALERT_COLUMNS) for f in frames]
    return reduce(lambda a, b: a.unionByName(b), frames)


def severity_counts(alerts: DataFrame) -> DataFrame:
    """A10: HIGH / MEDIUM / LOW counts, zero-filled; CRITICAL is not counted."""
    a = alerts.agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s.lower() + "_count")
                     for s in ("HIGH", "MEDIUM", "LOW")])
    return a


def counts_by(alerts: DataFrame, col: str) -> DataFrame:
    """Alert counts by type or by engine (missing engine → 'unknown')."""
    key = F.coalesce(F.col(col), F.lit("unknown")) if col == "engine_name" else F.col(col)
    return alerts.groupBy(key.alias(col)).agg(F.count(F.lit(1)).alias("alert_count"))


def alert_bundle(alerts: DataFrame) -> DataFrame:
    """The report's bundle, one row per alert: (threat_type, severity,
    description, evidence, ioc). Every alert is in it; a writer partitions the
    rows by ``threat_type`` (``write.partitionBy``), so no type is gathered
    into one list or task."""
    return alerts.select("threat_type", "severity", "description", "evidence", "ioc")


def select_alerts(alerts: DataFrame, severity: str | None = None, threat_type: str | None = None) -> DataFrame:
    """Filter alerts by severity and/or type."""
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    if threat_type:
        alerts = alerts.where(F.col("threat_type") == threat_type)
    return alerts


def first_n(alerts: DataFrame, n: int, order: list | None = None) -> DataFrame:
    """First N alerts under a total order (priority, then content)."""
    order = order or [c for c in ("priority",) if c in alerts.columns] + [
        "engine_name", "threat_type", "severity", "description"]
    return alerts.orderBy(*order).limit(n)


def ioc_string(alerts: DataFrame) -> DataFrame:
    """Flat, hash-friendly projection of an alert table (no maps)."""
    return alerts.select(
        "engine_name", "threat_type", "severity",
        F.round("confidence", 6).alias("confidence"),
        F.array_join(F.col("ioc"), ",").alias("ioc"),
        "mitre_technique",
        *[c for c in ("priority",) if c in alerts.columns],
    )


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add a 1-based rank to an already-limited (bounded) top-k frame."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
