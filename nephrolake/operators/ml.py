"""Risk models with MLlib: median imputation, assembly, classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import all_metrics


def pipeline(kind: str, columns: list[str], label: str = "target", scaled: bool = False, trees: int = 100) -> Pipeline:
    """``lr``: logistic regression; ``gbt``: boosted trees of depth 3."""
    filled = [f"{c}__filled" for c in columns]
    stages = [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="assembled")]
    if scaled:
        stages.append(StandardScaler(inputCol="assembled", outputCol="features", withMean=True))
    features = "features" if scaled else "assembled"
    if kind == "lr":
        stages.append(LogisticRegression(featuresCol=features, labelCol=label, maxIter=1000))
    elif kind == "gbt":
        stages.append(GBTClassifier(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=3, stepSize=0.1, seed=42))
    else:
        raise ValueError(f"Unknown model: {kind}")
    return Pipeline(stages=stages)


def stratified(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A split by hashed key within each class: the same rows whatever the partitions."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col(key)), F.lit(10_000)) / 10_000.0
    return df.filter(at >= test), df.filter(at < test)


def fit_and_score(train: DataFrame, test: DataFrame, kind: str, columns: list[str], label: str = "target", scaled: bool = False,
        trees: int = 100) -> tuple[PipelineModel, DataFrame]:
    """The model, and its metrics on ``test`` as one row."""
    model = pipeline(kind, columns, label, scaled, trees).fit(train)
    scored = model.transform(test).select(F.lit(kind).alias("model"), F.col(label).cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))
    return model, all_metrics(scored, ["model"])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
