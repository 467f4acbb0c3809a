"""Domain classifier (M8 training, M9 evaluation, M10 batch scoring) with pyspark.ml.

Features are the 15 column expressions of M6 (no Python per row); the model
is a ``Pipeline(VectorAssembler, StandardScaler, GBTClassifier)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions import domain as dom
from netsift.session import stored

# --- fixed values (training configuration) ------------------------------------------
TREES = 200
MAX_DEPTH = 8
STEP_SIZE = 0.05
TRAIN_FRACTION = 0.8
SEED = 42
SCORE_THRESHOLD = 0.85
# ------------------------------------------------------------------------------------


def feature_frame(names: DataFrame, col: str = "domain") -> DataFrame:
    """M6 as 15 typed columns next to the name."""
    return names.select(col, *[c for c in names.columns if c != col],
                        dom.features(col).alias("_f")).select("*", "_f.*").drop("_f")


def labelled_domains(flows: DataFrame) -> DataFrame:
    """Training set over the test tables: distinct server names, label 1 for '.xyz'.

    The names are stored: training, scores and curves go over them many times,
    and a filter on a score would else be pushed below the distinct, to every flow.
    """
    names = flows.where(F.col("requested_server_name").isNotNull()).select(F.col("requested_server_name").alias("domain")).distinct()
    return stored(names, "domain-model", "names").withColumn("label", F.col("domain").endswith(".xyz").cast("double"))


#: Hex digits of the hash that name a bucket of the distributed rank, and buckets of scores.
RANK_PREFIX = 3
SCORE_BUCKETS = 4096


def split(labelled: DataFrame, fraction: float = TRAIN_FRACTION, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """M8: of each label exactly ``floor(fraction * n)`` rows to train on, by the order of their seeded hash; the rest to test.

    The rank is the rank inside a bucket of hashes plus the sizes of the buckets
    before, so no task holds a whole label.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("domain")))
    rows = labelled.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, RANK_PREFIX))
    whole = Window.partitionBy("label")
    sizes = rows.groupBy("label", "_b").agg(F.count(F.lit(1)).alias("_c"))
    sizes = sizes.select("label", "_b", (F.sum("_c").over(whole.orderBy("_b")) - F.col("_c")).alias("_before"),
                         F.sum("_c").over(whole).alias("_n"))  # 4,096 rows a label
    rank = F.row_number().over(Window.partitionBy("label", "_b").orderBy("_h", "domain")) + F.col("_before")
    ranked = rows.join(sizes, ["label", "_b"]).withColumn("_train", rank <= F.floor(F.col("_n") * F.lit(fraction)))
    return (ranked.where("_train").select(*labelled.columns), ranked.where("not _train").select(*labelled.columns))


def area_under_curve(rated: DataFrame) -> DataFrame:
    """M9: (positives, negatives, auc) of (label 0 or 1, score), exact: the share of (positive, negative)
    pairs in which the positive scores higher, ties counting half; null if a label is missing.

    Rows are first counted per score. The negatives below a score are those in
    lower buckets of the scores' range and those below it in its own bucket.
    """
    positive = F.col("label") == 1
    per_score = rated.where(F.col("score").isNotNull() & F.col("label").isNotNull()).groupBy(F.col("score").cast("double").alias("score")) \
        .agg(F.count(F.when(positive, 1)).alias("p"), F.count(F.when(~positive, 1)).alias("n"))
    per_score = stored(per_score, "domain-model", "per-score")
    low, high = per_score.agg(F.min("score"), F.max("score")).first()
    span = (high - low) if low is not None and high > low else 1.0
    bucket = F.floor((F.col("score") - F.lit(low or 0.0)) / F.lit(span) * SCORE_BUCKETS)
    per_score = per_score.withColumn("_b", bucket)
    sizes = per_score.groupBy("_b").agg(F.sum("n").alias("_n"))
    sizes = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))  # 4,097 rows
    inside = F.sum("n").over(Window.partitionBy("_b").orderBy("score")) - F.col("n")
    below = per_score.join(sizes, "_b").withColumn("_below", inside + F.col("_before"))
    wins = F.sum(F.col("p").cast("double") * (F.col("_below") + F.col("n") / 2))
    totals = below.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"), wins.alias("wins"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return totals.select("positives", "negatives", F.when(pairs > 0, F.col("wins") / pairs).alias("auc"))


def pipeline(trees: int = TREES, depth: int = MAX_DEPTH, step: float = STEP_SIZE, seed: int = SEED) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=dom.FEATURE_NAMES, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth,
                      stepSize=step, seed=seed),
    ])


def train(labelled: DataFrame, **kw) -> PipelineModel:
    """M8: fit the pipeline on ``labelled(domain, label)``; the features are computed once, for all passes."""
    return pipeline(**kw).fit(stored(feature_frame(labelled), "domain-model", "features"))


def score(model: PipelineModel, names: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """``(domain, probability, is_suspicious)`` for distinct names."""
    out = model.transform(feature_frame(names.select("domain").distinct()))
    p = vector_to_array("probability").getItem(1)
    return out.select("domain", p.alias("probability"), (p >= threshold).alias("is_suspicious"))


@dataclass
class Evaluation:
    auc: float
    confusion: DataFrame
    summary: DataFrame
    importances: list[tuple[str, float]]


def evaluate(model: PipelineModel, test: DataFrame) -> Evaluation:
    """M9: AUC, confusion matrix, accuracy / FP / FN, top-5 feature importances."""
    pred = model.transform(feature_frame(test))
    auc = area_under_curve(pred.select("label", vector_to_array("probability").getItem(1).alias("score"))).first()["auc"]
    confusion = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    summary = pred.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        F.count(F.when((F.col("label") == 0) & (F.col("prediction") == 1), 1)).alias("false_positives"),
        F.count(F.when((F.col("label") == 1) & (F.col("prediction") == 0), 1)).alias("false_negatives"))
    gbt = model.stages[-1]
    imp = sorted(zip(dom.FEATURE_NAMES, gbt.featureImportances.toArray().tolist()), key=lambda x: -x[1])[:5]
    return Evaluation(auc, confusion, summary, imp)
