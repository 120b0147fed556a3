"""Tables behind the holdout report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..operators.joins import prediction_context_join
from ..operators.metrics import class_recall_table, confusion_matrix, topk_chart_rows


def holdout_report_tables(
    predictions: DataFrame,
    panel: DataFrame,
    importance: DataFrame,
    *,
    on: Sequence[str],
    actual: str = "actual_decision",
    predicted: str = "predicted_decision",
    classes: Sequence = K.DECISION_CLASSES,
    rate: str = "policy_rate_after",
    labour: Sequence[str] = ("unemployment", "natural_unemployment"),
    top: int = K.CHART_FEATURES,
) -> dict[str, DataFrame]:
    """Rate path, labour path, matrix, recall, top features and headline counts."""
    context = prediction_context_join(predictions, panel, on=on, context=[rate, *labour])
    marked = context.withColumn("incorrect", F.col(actual) != F.col(predicted))
    return {
        "rate_path": marked.select(*on, rate, predicted, "incorrect"),
        "labour_path": marked.select(*on, *labour, predicted, "incorrect"),
        "confusion_matrix": confusion_matrix(
            predictions, actual=actual, predicted=predicted, labels=list(classes)
        ),
        "class_recall": class_recall_table(predictions, actual=actual, predicted=predicted),
        "top_features": topk_chart_rows(
            importance, value="random_forest_importance", name="feature", k=top
        ),
        "headline": headline_counts(predictions, date=on[-1], actual=actual, predicted=predicted),
    }


def headline_counts(
    predictions: DataFrame, *, date: str, actual: str, predicted: str
) -> DataFrame:
    hit = F.col(actual) == F.col(predicted)
    return predictions.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(hit).alias("correct"),
        F.avg(hit.cast("int")).alias("accuracy"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )
