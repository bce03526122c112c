"""Classifier evaluation from a probability column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.schemas import LABEL

PROBABILITY = "churn_probability"


def auc(df: DataFrame, label: str = LABEL, probability: str = PROBABILITY) -> float:
    """Exact area under the ROC curve, from a distributed sort of the scores."""
    evaluator = BinaryClassificationEvaluator(rawPredictionCol=probability, labelCol=label, numBins=0)
    return evaluator.evaluate(df.select(F.col(probability), F.col(label).cast("double").alias(label)))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def threshold_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = LABEL,
    probability: str = PROBABILITY,
    threshold: float = 0.5,
) -> DataFrame:
    """Precision, recall and F1 of ``probability >= threshold``; 0/0 is 0."""
    predicted, actual = F.col(probability) >= threshold, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by,
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
