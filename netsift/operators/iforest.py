"""Isolation forest (M4 fit, M5 predict) on Spark.

Fit: features are cleaned (P13) and standard-scaled (M3, population
deviation). Each tree needs ``max_samples`` (<= 256) rows drawn without
replacement: a Bernoulli pre-sample of the table is spread over the trees by
a per-(row, tree) hash and cut to ``max_samples`` rows per tree with
``row_number`` (a partial WindowGroupLimit), so at most trees × samples rows
move. ``groupBy(tree).applyInPandas`` grows each tree with numpy (random
feature, uniform threshold between the node's min and max, depth limit
ceil(log2(samples))). The forest is a small node table (trees × < 2·samples
rows), collected once and broadcast.

Predict: a pandas UDF over the scaled features alone walks all trees over Arrow
batches with vectorised numpy, so columns that nobody reads are not computed; score = 2^(−E[h(x)] / c(ψ)) (the negated score_samples), offset = the
``contamination`` quantile of the training scores (exact, distributed), and
``anomaly_score = −(score_samples − offset)``, ``is_anomaly = score_samples < offset``.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.operators.anomaly import ML_FEATURES, clean_feature, present_features
from netsift.operators.quantiles import quantiles

EULER = 0.5772156649015329
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int")


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def grow_tree(x: np.ndarray, tree: int, seed: int, max_depth: int) -> list[tuple]:
    """One isolation tree as node rows (feature -1 marks a leaf)."""
    rng = np.random.default_rng(seed + 7919 * tree)
    nodes: list[list] = []

    def build(idx: np.ndarray, depth: int) -> int:
        nid = len(nodes)
        nodes.append([tree, nid, -1, 0.0, -1, -1, int(len(idx)), depth])
        if depth >= max_depth or len(idx) <= 1:
            return nid
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            return nid
        f = int(rng.choice(cand))
        thr = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < thr
        left = build(idx[mask], depth + 1)
        right = build(idx[~mask], depth + 1)
        nodes[nid][2:6] = [f, thr, left, right]
        return nid

    build(np.arange(len(x)), 0)
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForestModel:
    features: list[str]
    means: list[float]
    stds: list[float]
    nodes: pd.DataFrame          # NODE_SCHEMA rows
    max_samples: int
    offset: float
    contamination: float

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "means": self.means, "stds": self.stds,
                           "max_samples": self.max_samples, "offset": self.offset,
                           "contamination": self.contamination})


def _scaled(df: DataFrame, feats: list[str], means, stds) -> DataFrame:
    return df.select("*", *[((clean_feature(c) - F.lit(m)) / F.lit(s if s > 0 else 1.0)).alias(f"_z{i}")
                            for i, (c, m, s) in enumerate(zip(feats, means, stds))])


@dataclass
class Forest:
    """The trees as full binary trees of one depth: the children of node i are 2i + 1 (below the threshold) and 2i + 2.

    A leaf above the last level hands every row down to its left, so all rows take the same steps.
    """

    depth: int
    features: np.ndarray     # tree x inner node
    thresholds: np.ndarray   # tree x inner node
    lengths: np.ndarray      # tree x node of the last level: path length of a row that ends there

    @classmethod
    def of(cls, nodes: pd.DataFrame) -> Forest:
        depth = int(nodes["depth"].max())
        inner = 2 ** depth - 1
        trees = [t for _, t in nodes.sort_values(["tree", "node"]).groupby("tree")]
        features = np.zeros((len(trees), inner), np.int64)
        thresholds = np.full((len(trees), inner), np.inf)
        lengths = np.zeros((len(trees), inner + 1))
        for i, t in enumerate(trees):
            length = t["depth"].to_numpy() + c_factor(t["size"].to_numpy())
            feature, threshold, left, right, level = (t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth"))
            at = np.zeros(len(t), np.int64)
            for n in range(len(t)):  # parents come before their children
                if feature[n] >= 0:
                    features[i, at[n]], thresholds[i, at[n]] = feature[n], threshold[n]
                    at[left[n]], at[right[n]] = 2 * at[n] + 1, 2 * at[n] + 2
                else:
                    down = depth - level[n]
                    lengths[i, (at[n] + 1) * 2 ** down - 1 - inner] = length[n]
        return cls(depth, features, thresholds, lengths)


#: Rows that go through the trees at a time: what they need stays in the processor's cache.
WALK_ROWS = 4096


def _path_lengths(x: np.ndarray, forest: Forest) -> np.ndarray:
    """Mean path length over all trees for the rows of ``x``."""
    total = np.zeros(len(x))
    inner, width = forest.features.shape[1], x.shape[1]
    for s in range(0, len(x), WALK_ROWS):
        part = np.ascontiguousarray(x[s:s + WALK_ROWS])
        flat, row = part.ravel(), np.arange(len(part)) * width
        out = total[s:s + WALK_ROWS]
        for feature, threshold, length in zip(forest.features, forest.thresholds, forest.lengths):
            at = np.zeros(len(part), np.int64)
            for _ in range(forest.depth):
                right = ~(flat.take(row + feature.take(at)) < threshold.take(at))
                at *= 2
                at += 1
                at += right
            out += length.take(at - inner)
    return total / len(forest.lengths)


def fit(flows: DataFrame, n_estimators: int = 100, max_samples: int = 256, contamination: float = 0.05,
        seed: int = 42, features: list[str] = ML_FEATURES, oversample: float = 3.0,
        quantile_method: str = "exact") -> IsolationForestModel:
    """M4: fit the forest on ``flows``."""
    feats = present_features(flows, features)
    if not feats:
        raise ValueError("no ML feature columns present")
    stats = flows.agg(*[F.avg(clean_feature(c)).alias(f"m{i}") for i, c in enumerate(feats)],
                      *[F.stddev_pop(clean_feature(c)).alias(f"s{i}") for i, c in enumerate(feats)],
                      F.count(F.lit(1)).alias("n")).first()
    n = stats["n"]
    if n == 0:
        raise ValueError("cannot fit on an empty table")
    means = [float(stats[f"m{i}"] or 0.0) for i in range(len(feats))]
    stds = [float(stats[f"s{i}"] or 0.0) for i in range(len(feats))]
    psi = int(min(max_samples, n))
    z = _scaled(flows, feats, means, stds).select(*[f"_z{i}" for i in range(len(feats))],
                                                  F.monotonically_increasing_id().alias("_row"))
    frac = min(1.0, oversample * n_estimators * psi / n)
    pre = z.sample(fraction=frac, seed=seed) if frac < 1.0 else z
    p = min(1.0, oversample * psi / max(1.0, frac * n))
    row_hash = F.xxhash64("_row", F.lit(seed))  # of the row, not its values: equal rows go to trees independently

    def member(t):
        u = F.pmod(F.xxhash64(row_hash, t), F.lit(1_000_000)) / 1_000_000.0
        return u < F.lit(p)

    assigned = pre.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_estimators - 1)), member))
                          .alias("tree"))
    order = F.xxhash64(row_hash, F.col("tree"), F.lit(seed + 1))
    w = Window.partitionBy("tree").orderBy(order)
    picked = assigned.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= psi).drop("_rn")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    nf = len(feats)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf[[f"_z{i}" for i in range(nf)]].to_numpy(dtype=float)
        return pd.DataFrame(grow_tree(x, t, seed, max_depth),
                            columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])

    nodes = picked.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    if nodes["tree"].nunique() != n_estimators:
        raise ValueError(f"{nodes['tree'].nunique()} of {n_estimators} trees got rows")
    model = IsolationForestModel(feats, means, stds, nodes, psi, 0.0, contamination)
    train = _score_samples(flows, model)
    off = quantiles(train, {"s": F.col("_score_samples")}, contamination, quantile_method)["s"]
    model.offset = float(off) if off is not None else 0.0
    return model


def _score_samples(flows: DataFrame, model: IsolationForestModel) -> DataFrame:
    z = _scaled(flows, model.features, model.means, model.stds)
    zcols = [f"_z{i}" for i in range(len(model.features))]
    forest = Forest.of(model.nodes)
    cpsi = float(c_factor([model.max_samples])[0]) or 1.0

    @F.pandas_udf("double")
    def samples(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.Series(-np.power(2.0, -_path_lengths(x, forest) / cpsi))

    return z.withColumn("_score_samples", samples(*zcols)).drop(*zcols)


def predict(flows: DataFrame, model: IsolationForestModel) -> DataFrame:
    """M5: ``anomaly_score`` (= −decision_function) and ``is_anomaly``."""
    s = _score_samples(flows, model)
    return (s.withColumn("anomaly_score", F.lit(model.offset) - F.col("_score_samples"))
            .withColumn("is_anomaly", F.col("_score_samples") < F.lit(model.offset))
            .drop("_score_samples"))


def save(model: IsolationForestModel, spark, path: str) -> str:
    """Node table as Parquet plus the parameters as JSON."""
    spark.createDataFrame(model.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(model.to_json(),)], "params string").coalesce(1).write.mode("overwrite") \
        .text(f"{path}/params")
    return path


def load(spark, path: str) -> IsolationForestModel:
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    p = json.loads(spark.read.text(f"{path}/params").first()[0])
    return IsolationForestModel(p["features"], p["means"], p["stds"], nodes, p["max_samples"], p["offset"],
                                p["contamination"])
