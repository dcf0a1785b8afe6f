"""The learnt recommendation of a category (C-20, S-13)."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorikeet.operators import boosting
from lorikeet.operators.recommend import fallback_category

FEATURES = (
    "verbal_accuracy", "selection_accuracy", "category_difficulty", "time_spent", "success_rate", "previous_attempts"
)


def train(rows: DataFrame, label: str = "recommended_category", seed: int = 7) -> PipelineModel:
    """A forest over the six features; classes are those of the training rows."""
    index = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(rows)
    steps = [
        index,
        VectorAssembler(inputCols=list(FEATURES), outputCol="__features"),
        RandomForestClassifier(labelCol="__label", featuresCol="__features", numTrees=20, seed=seed),
        IndexToString(inputCol="prediction", outputCol="ml_recommendation", labels=index.labels),
    ]
    return Pipeline(stages=steps).fit(rows)


def predict(features: DataFrame, model: PipelineModel | None) -> DataFrame:
    """(child_id, ml_recommendation); without a model by the rule."""
    if model is None:
        return features.select("child_id", fallback_category(F.col("success_rate")).alias("ml_recommendation"))
    steps = PipelineModel(model.stages[1:])  # the label column isn't there
    return steps.transform(features).select("child_id", "ml_recommendation")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def boost(rows: DataFrame, label: str = "recommended_category", known: Sequence[str] = (), **settings) -> boosting.Boosted:
    """C-20: boosted trees over the six features. ``known`` are the classes of the
    model before, which stay; new ones are added."""
    return boosting.fit(rows, FEATURES, label, known, **settings)


def predict_boosted(features: DataFrame, model: boosting.Boosted) -> DataFrame:
    """(child_id, ml_recommendation) by boosted trees."""
    return boosting.predicted(features, model, "child_id", "ml_recommendation")


def predict_or_rule(features: DataFrame, path: str) -> DataFrame:
    """C-19, C-20: what the model at ``path`` says; by the rule where there is no
    readable model or one of its features is missing."""
    try:
        model = boosting.load(features.sparkSession, path)
    except (AnalysisException, ValueError, TypeError) as e:
        warnings.warn(f"no model at {path}, using the rule: {str(e).splitlines()[0]}", stacklevel=2)
        return predict(features, None)
    if missing := set(model.features) - set(features.columns):
        warnings.warn(f"features are missing, using the rule: {sorted(missing)}", stacklevel=2)
        return predict(features, None)
    return predict_boosted(features, model)
