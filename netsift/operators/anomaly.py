"""Anomaly scoring: feature cleaning (P13), robust deviation score (M1),
contamination flag (M2), standard scaling (M3) and the summary (A13).

Only scalars (medians, MADs, the max, the threshold, means and deviations)
come back to the driver; they are injected into the per-row projection as
literals, so scoring is one narrow map over the flows with no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.operators.quantiles import quantiles

# --- fixed values -------------------------------------------------------------
ML_FEATURES = [
    "bidirectional_packets", "bidirectional_bytes",
    "src2dst_packets", "src2dst_bytes", "dst2src_packets", "dst2src_bytes",
    "bidirectional_duration_ms", "bidirectional_mean_ps", "bidirectional_stddev_ps",
    "bidirectional_mean_piat_ms", "bidirectional_stddev_piat_ms",
]
SCORE_COLUMNS = ["bidirectional_bytes", "bidirectional_packets", "bidirectional_duration_ms"]
INF_REPLACEMENT = 1e10
CONTAMINATION = 0.05
# ------------------------------------------------------------------------------


def clean_feature(c) -> Column:
    """NULL/NaN → 0, ±inf → 1e10, as DOUBLE."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return (F.when(c.isNull() | F.isnan(c), F.lit(0.0))
            .when(c == float("inf"), F.lit(INF_REPLACEMENT))
            .when(c == float("-inf"), F.lit(INF_REPLACEMENT))
            .otherwise(c))


def present_features(df: DataFrame, features: list[str] = ML_FEATURES) -> list[str]:
    return [f for f in features if f in df.columns]


def clean_features(df: DataFrame, features: list[str] = ML_FEATURES) -> DataFrame:
    """P13 over the present feature columns (others untouched)."""
    feats = set(present_features(df, features))
    return df.select(*[clean_feature(c).alias(c) if c in feats else F.col(c) for c in df.columns])


def robust_scores(flows: DataFrame, columns: list[str] = SCORE_COLUMNS,
                  method: str = "exact") -> tuple[DataFrame, dict]:
    """M1: score = Σ |x − median| / MAD over the present columns with MAD > 0,
    divided by the maximum score when that is > 0. Adds ``anomaly_score``.

    Returns the scored frame and the fitted scalars.
    """
    cols = [c for c in columns if c in flows.columns]
    if not cols:
        return flows.withColumn("anomaly_score", F.lit(0.0)), {}
    x = {c: clean_feature(c) for c in cols}
    med = quantiles(flows, x, 0.5, method)
    mad = quantiles(flows, {c: F.abs(x[c] - F.lit(med[c])) for c in cols if med[c] is not None}, 0.5, method)
    score = F.lit(0.0)
    used = []
    for c in cols:
        m = mad.get(c)
        if m is not None and m > 0:
            score = score + F.abs((x[c] - F.lit(med[c])) / F.lit(m))
            used.append(c)
    raw = flows.withColumn("anomaly_score", score)
    mx = raw.agg(F.max("anomaly_score")).first()[0] if used else 0.0
    if mx is not None and mx > 0:
        raw = flows.withColumn("anomaly_score", score / F.lit(mx))
    return raw, {"median": med, "mad": mad, "max": mx, "used": used}


def flag_anomalies(scored: DataFrame, contamination: float = CONTAMINATION,
                   method: str = "exact", require_positive: bool = False) -> tuple[DataFrame, float | None]:
    """M2: is_anomaly = score >= quantile(score, 1 - contamination).

    ``require_positive`` additionally needs score > 0 (all-equal data would
    otherwise flag every flow, as the reference does).
    """
    thr = quantiles(scored, {"s": F.col("anomaly_score")}, 1 - contamination, method)["s"]
    if thr is None:
        flag = F.lit(False)
    else:
        flag = F.col("anomaly_score") >= F.lit(thr)
        if require_positive:
            flag = flag & (F.col("anomaly_score") > 0)
    return scored.withColumn("is_anomaly", flag), thr


def score_flows(flows: DataFrame, contamination: float = CONTAMINATION, method: str = "exact") -> DataFrame:
    """M1 + M2: the unsupervised branch the reference runs by default."""
    scored, _ = robust_scores(flows, method=method)
    flagged, _ = flag_anomalies(scored, contamination, method)
    return flagged


ANOMALY_COLUMNS = ["src_ip", "dst_ip", "dst_port", "bidirectional_bytes", "anomaly_score"]


def anomaly_summary(scored: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """Totals, anomaly count and rate (%), and the top ``k`` anomalies."""
    summary = scored.agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.count(F.when(F.col("is_anomaly"), 1)).alias("anomaly_count")) \
        .withColumn("anomaly_rate", F.when(F.col("total_flows") > 0,
                                           F.col("anomaly_count") * 100.0 / F.col("total_flows")).otherwise(0.0))
    top = (scored.where(F.col("is_anomaly")).select(*ANOMALY_COLUMNS)
           .orderBy(F.desc("anomaly_score"), F.desc("bidirectional_bytes"), "src_ip", "dst_ip", "dst_port")
           .limit(k))
    return {"summary": summary, "top_anomalies": top}


def standard_scale(df: DataFrame, features: list[str] = ML_FEATURES, ddof: int = 0,
                   keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    """M3: (x − mean) / std over cleaned features; std with ``ddof`` (0 =
    population, the outside library's choice; pyspark.ml uses 1). A zero
    deviation scales by 1.
    """
    feats = present_features(df, features)
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[F.avg(clean_feature(c)).alias("m_" + c) for c in feats],
                 *[std(clean_feature(c)).alias("s_" + c) for c in feats]).first()
    params = {c: (row["m_" + c] or 0.0, row["s_" + c] or 0.0) for c in feats}
    out = [F.col(k) for k in (keep or [])]
    for c in feats:
        m, s = params[c]
        s = s if s and s > 0 else 1.0
        out.append(((clean_feature(c) - F.lit(m)) / F.lit(s)).alias(c))
    return df.select(*out), params
