"""Monthly snapshots: each customer expanded over the months it was active."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions import clip, gaussian_noise, risk_segment, round_even
from ebbline.operators.scoring import expected_months, revenue_at_risk
from ebbline.schemas import SNAPSHOT_COLUMNS

NOISE_SCALE = 0.03
MINIMUM_REVENUE = 18.0


def month_end(anchor: Column, months_back: Column) -> Column:
    """The last day of the month that lies ``months_back`` before the anchor's."""
    return F.last_day(F.add_months(anchor, -months_back.cast("int")))


def customer_months(df: DataFrame, anchor: Column, periods: int = 12) -> DataFrame:
    """One row per customer and month in which the tenure was still positive.

    The months are generated within each row (``tenure - m > 0`` is the bound
    of the sequence), so nothing is joined, shuffled or thrown away again.
    """
    last = F.least(F.lit(periods), F.col("tenure")) - 1
    months = F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))
    expanded = df.where(F.col("tenure") > 0).withColumn("months_back", F.explode(months))
    return expanded.withColumns(
        {
            "snapshot_date": month_end(anchor, F.col("months_back")),
            "tenure_at_snapshot": F.col("tenure") - F.col("months_back"),
        }
    )


def revenue_noise(seed: int = 42) -> Column:
    return gaussian_noise(F.col("months_back") + F.lit(seed), F.col("customerID"), NOISE_SCALE)


def customer_snapshots(scores: DataFrame, anchor: date, periods: int = 12, seed: int = 42) -> DataFrame:
    """The snapshot table from daily scores, as one narrow plan.

    The probability falls by 0.015 per month back, and by 0.01 in every month
    for a customer whose current segment is high.
    """
    months = customer_months(scores.drop("snapshot_date"), F.lit(anchor), periods)
    currently_high = F.col("risk_segment").eqNullSafe("high").cast("double")
    shift = F.col("months_back") * F.lit(0.015) + currently_high * F.lit(0.01)
    revenue = round_even(F.col("MonthlyCharges") * (F.lit(1.0) + revenue_noise(seed)), 2)
    moved = months.withColumns(
        {
            "monthly_revenue": clip(revenue, lower=MINIMUM_REVENUE),
            "churn_probability": clip(F.col("churn_probability") - shift, 0.01, 0.99),
            "expected_months_remaining": expected_months(tenure="tenure_at_snapshot"),
        }
    )
    event = (F.col("churn_flag") == 1) & (F.col("months_back") == 0)
    return moved.withColumns(
        {
            "revenue_at_risk": revenue_at_risk(
                F.col("churn_probability"), F.col("monthly_revenue"), F.col("expected_months_remaining")
            ),
            "risk_segment": risk_segment(),
            "observed_churn_event": F.coalesce(event, F.lit(False)).cast("bigint"),
            "active_customer_flag": F.lit(1).cast("bigint"),
        }
    ).select(SNAPSHOT_COLUMNS)
