"""Boosted-tree classifier on Spark ML: training that stops by a validation split, scores, importances."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import ModelConfig
from tidemark.functions.numeric import finite
from tidemark.functions.shared import stored

MISSING = -999.0
VALUE, ABSENT = "f_", "m_"


def _number(df: DataFrame, features: list[str]) -> dict:
    return {c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in features}


def preparation(features: list[str], flagged: list[str]) -> SQLTransformer:
    """Each feature as a double f_<name>, with a sentinel for null, NaN and infinity, and for those in ``flagged`` m_<name>, which is 1 there:
    trees bin values, so the sentinel alone would share a bin with small values. It is stored with the model."""
    fine = {c: f"coalesce(abs(CAST(`{c}` AS DOUBLE)) < double('infinity'), false)" for c in features}
    values = [f"CASE WHEN {fine[c]} THEN CAST(`{c}` AS DOUBLE) ELSE {MISSING}D END AS `{VALUE}{c}`" for c in features]
    marks = [f"CASE WHEN {fine[c]} THEN 0D ELSE 1D END AS `{ABSENT}{c}`" for c in flagged]
    return SQLTransformer(statement=f"SELECT *, {', '.join(values + marks)} FROM __THIS__")


def train(df: DataFrame, features: list[str], cfg: ModelConfig = ModelConfig()) -> PipelineModel:
    """Fits on split train, and keeps the trees up to the best iteration on split validation, once ``patience`` more gave nothing better.

    Features with a value missing in split train get an indicator of that."""
    chosen = df.where("split in ('train', 'validation') and win is not null")
    rows = stored(chosen.select(*(x.alias(c) for c, x in _number(df, features).items()), F.col("win").cast("double").alias("label"), (F.col("split") == "validation").alias("held")), "training")
    holes = rows.where("not held").agg(*(F.count_if(~F.coalesce(finite(F.col(c)), F.lit(False))).alias(c) for c in features)).first()
    flagged = [c for c in features if holes[c]]
    stages = [preparation(features, flagged), VectorAssembler(inputCols=[f"{VALUE}{c}" for c in features] + [f"{ABSENT}{c}" for c in flagged], outputCol="features")]
    ready = stages[1].transform(stages[0].transform(rows)).select("features", "label", "held")
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=cfg.max_trees, stepSize=cfg.learning_rate, maxDepth=cfg.depth, minInstancesPerNode=cfg.min_leaf, subsamplingRate=cfg.row_share,
        featureSubsetStrategy=cfg.column_share, seed=cfg.seed,
    )
    return PipelineModel([*stages, _stopped(trees, ready.where("not held"), ready.where("held"), cfg)])


def best_iteration(losses: list[float], patience: int) -> tuple[int, bool]:
    """Place of the least loss before the first run of ``patience`` that gave nothing less, and whether there is such a run."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def _stopped(trees: GBTClassifier, rows: DataFrame, held: DataFrame, cfg: ModelConfig) -> GBTClassificationModel:
    """Boosting can't be taken up again here, so it starts with twice the patience and doubles until the curve has turned: at most four
    times the trees that are needed, however many are allowed. Without rows to validate by, all trees are fitted and stay."""
    if not held.head(1):
        return trees.fit(rows)
    n = min(cfg.max_trees, 2 * cfg.patience)
    while True:
        fitted = trees.copy({trees.maxIter: n}).fit(rows)
        best, turned = best_iteration(fitted.evaluateEachIteration(held), cfg.patience)
        if turned or n == cfg.max_trees:
            return first_trees(fitted, best + 1)
        n = min(cfg.max_trees, 2 * n)


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first n trees."""
    gateway = SparkSession.active().sparkContext._gateway
    java, jvm = model._java_obj, gateway.jvm
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    for i, (tree, weight) in enumerate(zip(list(java.trees())[:n], list(java.treeWeights())[:n], strict=True)):
        trees[i], weights[i] = tree, weight
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights))


def curve(model: PipelineModel, df: DataFrame, split: str = "validation") -> list[float]:
    """Log loss on a split after each of the model's trees."""
    rows = df.where((F.col("split") == split) & F.col("win").isNotNull()).withColumns(_number(df, model_features(model)) | {"label": F.col("win").cast("double")})
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    return [x / 2 for x in model.stages[-1].evaluateEachIteration(rows.select("features", "label"))]  # Spark counts twice the log loss


def model_features(model: PipelineModel) -> list[str]:
    return [c.removeprefix(VALUE) for c in model.stages[1].getInputCols() if c.startswith(VALUE)]


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The rows with p, the probability of a win; a feature that isn't there counts as missing."""
    absent = [c for c in model_features(model) if c not in df.columns]
    out = model.transform(df.withColumns(_number(df, absent)))
    return out.select(*df.columns, vector_to_array("probability")[1].alias("p"))


def importance(model: PipelineModel, df: DataFrame, n: int = 20) -> DataFrame:
    """The n features with the highest gain, indicators as <name>_missing; ``df`` is only there for its session."""
    names = [c.removeprefix(VALUE) if c.startswith(VALUE) else f"{c.removeprefix(ABSENT)}_missing" for c in model.stages[1].getInputCols()]
    gains = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(names, gains + [0.0] * (len(names) - len(gains)), strict=True))  # the model only knows features up to the last one used
    return df.sparkSession.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), "feature").limit(n)


def evaluate(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics and AUC of each split."""
    from tidemark.operators import metrics

    rows = scored.where("split is not null").withColumn("y", F.col("win").cast("double"))
    return metrics.classification_metrics(rows, ["split"], threshold).join(metrics.roc_auc(rows, ["split"]), "split")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
