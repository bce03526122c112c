"""Revenue-at-risk scoring on top of a churn probability column."""

from __future__ import annotations

from datetime import date

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions import clip, lookup, risk_segment, round_even, utc_today
from ebbline.schemas import CONTRACT_BUFFER_MONTHS, SCORE_COLUMNS


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``churn_probability``, the probability of class 1."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("churn_probability"))


def expected_months(contract: str = "Contract", tenure: str = "tenure") -> Column:
    """Remaining months: a buffer by contract less a tenure discount, at least 1."""
    buffer = lookup(contract, CONTRACT_BUFFER_MONTHS, "6")
    discount = clip(F.col(tenure) / F.lit(12.0), 0.0, 6.0)
    return round_even(clip(buffer - discount, lower=1.0), 2)


def revenue_at_risk(probability: Column, revenue: Column, months: Column) -> Column:
    return round_even(probability * revenue * months, 2)


def score_output(df: DataFrame, snapshot_date: date | None = None) -> DataFrame:
    """Add revenue, months, risk and date to records with a probability.

    ``snapshot_date`` is the run date; leaving it out means today in UTC.
    """
    with_months = df.withColumns(
        {
            "monthly_revenue": F.col("MonthlyCharges"),
            "expected_months_remaining": expected_months(),
        }
    )
    return with_months.withColumns(
        {
            "revenue_at_risk": revenue_at_risk(
                F.col("churn_probability"), F.col("monthly_revenue"), F.col("expected_months_remaining")
            ),
            "risk_segment": risk_segment(),
            "snapshot_date": F.lit(snapshot_date) if snapshot_date else utc_today(),
        }
    )


def batch_scores(df: DataFrame, snapshot_date: date | None = None) -> DataFrame:
    """The daily score table from features with a probability."""
    return score_output(df, snapshot_date).select(SCORE_COLUMNS)


def score_response(scored: DataFrame) -> DataFrame:
    """The six-column answer for a scored record."""
    return scored.select(
        F.col("customerID").alias("customer_id"),
        round_even(F.col("churn_probability"), 6).alias("churn_probability"),
        round_even(F.col("monthly_revenue"), 2).alias("monthly_revenue"),
        round_even(F.col("expected_months_remaining"), 2).alias("expected_months_remaining"),
        round_even(F.col("revenue_at_risk"), 2).alias("revenue_at_risk"),
        "risk_segment",
    )
